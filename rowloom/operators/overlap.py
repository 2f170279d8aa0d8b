"""Longest common subsequences of two texts, for use inside an Arrow batch.

A row of the usual table is kept as one integer whose bits say where the length grows, so a
token costs a few operations on machine words and whole texts of many thousand words are fine.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

_TOKEN = re.compile("[a-z0-9]+")


def _tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text or "")


def _where(tokens: list[str]) -> dict[str, int]:
    """A bit for each place of each token."""
    where: dict[str, int] = {}
    for at, token in enumerate(tokens):
        where[token] = where.get(token, 0) | (1 << at)
    return where


def _rows(left: list[str], where: dict[str, int], size: int) -> Iterator[int]:
    """For each prefix of ``left``: a bit per token on the right, 1 where the length does not grow."""
    full = (1 << size) - 1
    flat = full
    yield flat
    for token in left:
        hit = flat & where.get(token, 0)
        flat = ((flat + hit) | (flat - hit)) & full
        yield flat


def sequence_hits(prediction: str | None, target: str | None) -> tuple[int, int | None, int | None]:
    """Length of the longest common subsequence and both token counts (None if 0)."""
    left, right = _tokens(prediction), _tokens(target)
    last = 0
    for row in _rows(left, _where(right), len(right)):
        last = row  # one row is all that is kept
    hits = len(right) - last.bit_count()
    return hits, len(left) or None, len(right) or None


def _matched(target: list[str], prediction: list[str], where: dict[str, int]) -> set[int]:
    """Positions of the target in one longest common subsequence, read from the end."""
    rows, found = list(_rows(target, where, len(prediction))), set()
    i, j = len(target), len(prediction)

    def length(i: int, j: int) -> int:
        return j - (rows[i] & ((1 << j) - 1)).bit_count()

    while i and j:
        if target[i - 1] == prediction[j - 1]:
            i, j = i - 1, j - 1
            found.add(i)
        elif length(i, j - 1) > length(i - 1, j):
            j -= 1
        else:
            i -= 1
    return found


def summary_hits(prediction: str | None, target: str | None) -> tuple[int, int | None, int | None]:
    """Tokens of the target lines matched by any line of the prediction, each used once."""
    wanted = [t for line in (target or "").split("\n") if (t := _tokens(line))]
    given = [t for line in (prediction or "").split("\n") if (t := _tokens(line))]
    spare_given, spare_wanted = (Counter(t for line in lines for t in line) for lines in (given, wanted))
    # Each line of the prediction is indexed once, and only lines with a token in common are compared.
    places = [_where(line) for line in given]
    holders: dict[str, list[int]] = {}
    for number, where in enumerate(places):
        for token in where:
            holders.setdefault(token, []).append(number)
    n_given, n_wanted = spare_given.total(), spare_wanted.total()
    hits = 0
    for line in wanted:
        union: set[int] = set()
        for number in sorted({n for token in set(line) for n in holders.get(token, ())}):
            if len(union) < len(line):
                union |= _matched(line, given[number], places[number])
        for at in sorted(union):
            token = line[at]
            if spare_given[token] > 0 and spare_wanted[token] > 0:
                spare_given[token] -= 1
                spare_wanted[token] -= 1
                hits += 1
    return hits, n_given or None, n_wanted or None
