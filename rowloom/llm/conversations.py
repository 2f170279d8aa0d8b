"""The cheapest repair of conversations whose roles should read ``(s?(ua)+)?``.

The rows of a conversation and the four states of that pattern make a graph: a node is a state before a row, an arc is
an edit. The cost that is left from each node is found by doubling min-plus products of the rows' cost
tables. Of the arcs on cheapest ways, nodes are ranked by their least audits of 1, 2, 4, ... edits, each round from two ranks
of the round before, and the same rounds double the pointers along them; from the first node the pointers mark the way.

Work is dealt out in blocks of rows that lie next to each other, so a conversation of any length is cut into blocks. A block
sends one table of costs and one of states for the conversations at its two edges, and these are
chained per conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import arrow_batches
from rowloom.session import written

BLOCK_BITS = 16  # a block has at most 65,536 rows
WHITE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = np.array([USER, USER, ASSISTANT, USER])  # where an inserted or changed row leads
AT_END = np.array([0, 4, 2, 0])  # what is left after the last row: missing rows are inserted
FAR = 1 << 40
DELETE, INSERT, KEEP, REROLE = range(4)
LETTERS = np.array(["D", "I", "K", "R"])  # in ASCII order
COST = {DELETE: 3, INSERT: 2, REROLE: 2}
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)


def _tables() -> np.ndarray:
    """Cost of each way over a row, by its initial (3: another), its fault and the states before and after it."""
    tables = np.full((4, 4, 4, 4), FAR, np.int64)
    for initial in range(4):
        for fault in (SOUND, BLANK, DUPLICATE, TRUNCATED):
            for before in range(4):
                state, paid = before, 0
                for _ in range(4):  # insertions first
                    for letter in (DELETE, KEEP, REROLE):
                        after, cost = step(state, letter, initial, fault)
                        if after is not None:
                            way = tables[initial, fault, before]
                            way[after] = min(way[after], paid + cost)
                    state, paid = int(NEXT[state]), paid + COST[INSERT]
    return tables


def step(state: int, letter: int, initial: int, fault: int) -> tuple[int | None, int]:
    """The state after an edit of a row and what it costs; no state if the edit is not allowed."""
    if letter == DELETE:
        return state, COST[DELETE]
    if letter == INSERT:
        return int(NEXT[state]), COST[INSERT]
    if fault in (BLANK, DUPLICATE):
        return None, 0
    more = int(fault == TRUNCATED)
    if letter == REROLE:
        return int(NEXT[state]), COST[REROLE] + more
    if initial == 0:
        return (SYSTEM if state == START else None), more
    fits = initial < 3 and initial + 1 == NEXT[state]
    return (initial + 1 if fits else None), more


def _steps() -> tuple[np.ndarray, np.ndarray]:
    after, cost = np.full((4, 4, 4, 4), -1), np.zeros((4, 4, 4, 4), np.int64)
    for initial, fault, letter, state in np.ndindex(4, 4, 4, 4):
        to, paid = step(state, letter, initial, fault)
        after[initial, fault, letter, state], cost[initial, fault, letter, state] = -1 if to is None else to, paid
    return after, cost


TABLES = _tables()
AFTER, PAID = _steps()


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus products of stacks of cost tables."""
    found = np.full(a.shape, FAR, np.int64)
    for middle in range(4):
        np.minimum(found, a[:, :, middle, None] + b[:, middle, None, :], out=found)
    return found


class Block:
    """Neighbouring rows in order, cut into pieces by conversation."""

    def __init__(self, table: pa.Table) -> None:
        self.table = table.sort_by("place")
        conversation = self.table.column("conv_id")
        number, missing = conversation.fill_null(0).to_numpy(), conversation.is_null().to_numpy()
        self.initial, self.fault = (self.table.column(c).to_numpy().astype(np.int64) for c in ("initial", "fault"))
        self.rows = len(number)
        new = np.ones(self.rows, bool)
        new[1:] = (number[1:] != number[:-1]) | (missing[1:] != missing[:-1])
        self.begins = np.flatnonzero(new)
        self.ends = np.append(self.begins[1:], self.rows)
        self.piece = np.cumsum(new) - 1
        self.ids = [None if missing[b] else int(number[b]) for b in self.begins]

    def products(self) -> np.ndarray:
        """For each row, the cost table of all rows from it to the end of its piece."""
        found, left, size = TABLES[self.initial, self.fault], self.ends[self.piece] - np.arange(self.rows), 1
        while size < left.max():
            more = np.flatnonzero(left > size)
            found[more] = product(found[more], found[more + size])
            size *= 2
        return found

    def solve(self, after: np.ndarray, open_ends: np.ndarray) -> Ways:
        """Cheapest ways, given what is left after each piece; ``open_ends`` marks pieces that go on in the next block."""
        return Ways(self, after, open_ends)


class Ways:
    """Nodes are 4 * row + state, then 4 * (rows + piece) + state for the ends of pieces."""

    def __init__(self, block: Block, after: np.ndarray, open_ends: np.ndarray) -> None:
        rows, self.block = block.rows, block
        left = (block.products() + after[block.piece][:, None, :]).min(axis=2)
        here, states = np.arange(rows), np.arange(4)
        last = here == block.ends[block.piece] - 1
        beyond = np.where(last[:, None], after[block.piece], left[np.minimum(here + 1, rows - 1)])
        next_node = np.where(last, 4 * (rows + block.piece), 4 * (here + 1))
        count = 4 * (rows + len(block.begins))
        # targets[letter, node]: where an edit leads that lies on a cheapest way, or -1.
        targets = np.full((4, count), -1, np.int64)
        for letter in range(4):
            to, paid = AFTER[block.initial, block.fault, letter], PAID[block.initial, block.fault, letter]
            allowed = to >= 0
            to = np.maximum(to, 0)
            over = (left if letter == INSERT else beyond)[here[:, None], to]
            cheapest = allowed & (left == paid + over)
            node = (4 * here if letter == INSERT else next_node)[:, None] + to
            targets[letter, : 4 * rows] = np.where(cheapest, node, -1).ravel()
        closing = 4 * (rows + np.flatnonzero(~open_ends))[:, None] + states[[SYSTEM, USER]]
        targets[INSERT, closing] = closing + 1
        self.targets = targets
        self._rank(count)

    def _rank(self, count: int) -> None:
        """Rank nodes by their least audits and double the pointers along them.

        A letter leads from a node to one node only, so the least audit of a length has one end.
        """
        nodes = np.arange(count)
        some = self.targets >= 0
        resting = ~some.any(axis=0)
        letter = np.where(resting, 0, some.argmax(axis=0) + 1)
        pointer = np.where(resting, nodes, self.targets[letter - 1, nodes])
        rank, length, self.pointers = letter, (~resting).astype(np.int64), [pointer]
        while not resting[pointer].all():
            rank = np.unique(rank * (count + 1) + rank[pointer], return_inverse=True)[1]
            length = length + length[pointer]
            pointer = pointer[pointer]
            self.pointers.append(pointer)
        # Of a node's arcs the one of the least letter, then to the node of the least rank.
        order = np.where(some, np.arange(4)[:, None] * (count + 1) + rank[self.targets], FAR)
        self.letter, self.length, self.resting, self.last = order.argmin(axis=0), length, resting, pointer

    def exits(self, piece: int) -> list[int]:
        """In which state the piece is left, for each state in which it is entered."""
        begin = 4 * self.block.begins[piece]
        return (self.last[begin : begin + 4] - 4 * (self.block.rows + piece)).tolist()

    def path(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, number in the piece, letter and state before of each edit on the chosen ways, in order."""
        rows, pieces = self.block.rows, len(self.block.begins)
        on = np.zeros(len(self.letter), bool)
        on[4 * self.block.begins + entry] = True
        for pointer in self.pointers:
            on[pointer[on]] = True
        nodes = np.flatnonzero(on & ~self.resting)
        place = nodes // 4
        piece = np.where(place < rows, self.block.piece[np.minimum(place, rows - 1)], place - rows)
        order = np.lexsort((-self.length[nodes], piece))
        nodes, place, piece = nodes[order], place[order], piece[order]
        row = np.where(place < rows, place, self.block.ends[np.minimum(piece, pieces - 1)] - 1)
        whole = self.length[4 * self.block.begins + entry]
        return row, whole[piece] - self.length[nodes], self.letter[nodes], nodes % 4


def _edge_costs(key: tuple, table: pa.Table) -> pa.Table:
    """The cost tables of the first and the last piece of a block: the ones other blocks may go on with."""
    block = Block(table)
    found = block.products()
    edges = sorted({0, len(block.begins) - 1})
    return pa.table(
        {
            "conv_id": pa.array([block.ids[p] for p in edges], pa.int64()),
            "block": pa.array([key[0].as_py()] * len(edges), pa.int64()),
            "costs": pa.array([found[block.begins[p]].ravel().tolist() for p in edges], pa.list_(pa.int64())),
        }
    )


def _chain_costs(table: pa.Table) -> pa.Table:
    """What is left after each piece of a conversation that lies in several blocks; nothing for other ones."""
    rows = table.sort_by([("block", "descending")]).to_pylist()
    left, found = AT_END, []
    for row in rows:
        found.append(left.tolist())
        left = (np.array(row["costs"]).reshape(4, 4) + left[None, :]).min(axis=1)
    keep = len(rows) if len(rows) > 1 else 0
    return pa.table(
        {
            "conv_id": pa.array([r["conv_id"] for r in rows[:keep]], pa.int64()),
            "block": pa.array([r["block"] for r in rows[:keep]], pa.int64()),
            "after": pa.array(found[:keep], pa.list_(pa.int64())),
            "goes_on": pa.array([i > 0 for i in range(keep)], pa.bool_()),
        }
    )


def _linked(block: Block, links: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, dict]]:
    """What is left after each piece, whether it goes on, the state before it, and the links by piece."""
    pieces = len(block.ids)
    after, open_ends, entry = np.tile(AT_END, (pieces, 1)), np.zeros(pieces, bool), np.zeros(pieces, np.int64)
    found = {}
    for link in links.to_pylist():
        # A conversation has one piece in a block.
        piece = 0 if block.ids[0] == link["conv_id"] else pieces - 1
        after[piece], open_ends[piece], entry[piece] = link["after"], link["goes_on"], link.get("entry", 0)
        found[piece] = link
    return after, open_ends, entry, found


def _edge_states(table: pa.Table, links: pa.Table) -> pa.Table:
    """For pieces that are linked, the state they are left in by the state they are entered in."""
    rows = []
    if table.num_rows and links.num_rows:
        block = Block(table)
        after, open_ends, _, found = _linked(block, links)
        ways = block.solve(after, open_ends)
        rows = [link | {"exits": ways.exits(piece) if open_ends[piece] else [0] * 4} for piece, link in found.items()]
    fields = [("conv_id", pa.int64()), ("block", pa.int64()), ("after", pa.list_(pa.int64())), ("goes_on", pa.bool_()), ("exits", pa.list_(pa.int64()))]
    return pa.table({name: pa.array([r[name] for r in rows], kind) for name, kind in fields})


def _chain_states(table: pa.Table) -> pa.Table:
    rows = table.sort_by("block").to_pylist()
    state, entries = START, []
    for row in rows:
        entries.append(state)
        state = row["exits"][state]
    return table.sort_by("block").drop_columns(["exits"]).append_column("entry", pa.array(entries, pa.int64()))


EDITS = "conv_id bigint, turn bigint, role string, digest binary, place bigint, number bigint, edit string, new_role string, cost bigint"


def _edits(table: pa.Table, links: pa.Table) -> pa.Table:
    block = Block(table)
    after, open_ends, entry, _ = _linked(block, links)
    row, number, letter, state = block.solve(after, open_ends).path(entry)
    said = np.where(NEXT[state] == USER, "user", "assistant").astype(object)
    said[(letter == DELETE) | (letter == KEEP)] = None
    found = block.table.select(["conv_id", "turn", "role", "digest", "place"]).take(pa.array(row))
    cost = PAID[block.initial[row], block.fault[row], letter, state]
    more = {"number": number, "edit": LETTERS[letter], "new_role": said, "cost": cost}
    kinds = {"number": pa.int64(), "edit": pa.string(), "new_role": pa.string(), "cost": pa.int64()}
    for name, values in more.items():
        found = found.append_column(name, pa.array(values.tolist(), kinds[name]))
    return found


def _plain(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, digest``; a null role or text is one blank."""
    columns = [F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn")]
    columns += [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return rows.select(*columns).withColumn("digest", F.unhex(F.md5("text")))


def faults(rows: DataFrame) -> DataFrame:
    """Each row's place in its conversation and its first fault, in a table of the shared folder.

    Rows are in order of ``turn``, null first, then of role and a digest of the text. ``fault`` is 1 for a text of white space only, 2 for
    a role and text that came earlier, 3 for a text that ends without ``.``, ``!`` or ``?``, else 0. Texts are not
    shuffled: 128 bits of MD5 stand for them. Rows are dealt out by ranges of all order columns and a running number, so
    neither a long conversation nor equal rows meet in one task.
    """
    spark = rows.sparkSession
    end = F.rtrim("text", F.lit(WHITE))
    facts = _plain(rows).withColumn("end", end).select(
        "conv_id",
        "turn",
        "role",
        "digest",
        (F.col("end") == "").alias("blank"),
        F.substring("end", -1, 1).isin(".", "!", "?").alias("closed"),
        F.monotonically_increasing_id().alias("spread"),
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "role", "digest", "spread"]
    placed = facts.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("spread")
    placed = written(placed.withColumn("place", F.monotonically_increasing_id()), "turns")
    kinds = ["conv_id", "role", "digest"]
    again = placed.filter(~F.col("blank")).groupBy(*kinds).agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = again.select(*[F.col(c).alias(f"of_{c}") for c in kinds], "first")
    same: Column = F.lit(True)
    for c in kinds:
        same = same & F.col(c).eqNullSafe(F.col(f"of_{c}"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("place") > F.col("first"), DUPLICATE).when(~F.col("closed"), TRUNCATED).otherwise(SOUND)
    initial = F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2).otherwise(3)
    marked = placed.join(again, same, "left").select("conv_id", "turn", "role", "digest", "place", F.shiftright("place", BLOCK_BITS).alias("block"), initial.alias("initial"), fault.alias("fault"))
    return written(marked, "faults")


def cheapest_edits(found: DataFrame) -> DataFrame:
    """The edits of each conversation of ``faults``: ``place`` and ``number`` give their order.

    An edit keeps a row (K), deletes it (D, 3; required for blank and repeated ones), gives it another role (R, 2) or inserts an
    empty row (I, 2) before the row at ``place``, or behind the last. A truncated row that stays adds 1. Of equally cheap ways the one whose letters come
    first in ASCII order is taken.
    """
    costs = found.groupBy("block").applyInArrow(_edge_costs, "conv_id bigint, block bigint, costs array<bigint>")
    schema = "conv_id bigint, block bigint, after array<bigint>, goes_on boolean"
    links = written(costs.groupBy("conv_id").applyInArrow(_chain_costs, schema), "edge-costs")
    edges = found.join(links.select("block").distinct(), "block", "left_semi")
    states = edges.groupBy("block").cogroup(links.groupBy("block")).applyInArrow(_edge_states, f"{schema}, exits array<bigint>")
    links = written(states.groupBy("conv_id").applyInArrow(_chain_states, f"{schema}, entry bigint"), "edge-states")
    return found.groupBy("block").cogroup(links.groupBy("block")).applyInArrow(_edits, EDITS)


REPAIRED = "conv_id bigint, place bigint, number bigint, edit string, old_role string, role string, text string, cost bigint"


def repaired(rows: DataFrame, edits: DataFrame, whole: bool = False) -> DataFrame:
    """The edits with the roles and texts that they leave, in order: ``conv_id, place, number, edit, old_role, role, text, cost``.

    A deleted row has no new role and text, an inserted one no old role. Each text crosses the network once: texts and edits are dealt by
    the same ranges and sorted, so that an edit stands behind its row's text. With ``whole`` a
    conversation stays in one task, as a stream, for readers that need all of it in order.
    """
    spark = rows.sparkSession
    arrow_batches(spark)
    both = _plain(rows).unionByName(edits, allowMissingColumns=True)
    keys = ["conv_id", "turn", "role", "digest"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartition(parts, "conv_id") if whole else both.repartitionByRange(parts, *keys)
    lined = dealt.sortWithinPartitions(*keys, F.col("place").asc_nulls_first(), "number")
    return lined.select(*keys, "place", "number", "edit", "new_role", "cost", "text").mapInArrow(_merge, REPAIRED)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    text = None
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]
    names = ["conv_id", "place", "number", "edit", "old_role", "role", "text", "cost"]
    for batch in batches:
        found = []
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "place", "number", "edit", "role", "new_role", "text", "cost")]
        for conv_id, place, number, edit, role, new_role, own, cost in zip(*columns):
            if edit is None:
                text = own
            else:
                new = {"D": (None, None), "K": (role, text), "R": (new_role, text), "I": (new_role, "")}[edit]
                found.append((conv_id, place, number, edit, None if edit == "I" else role, *new, cost))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=names)


def digests(rows: DataFrame) -> DataFrame:
    """``conv_id, illegal, cost, audit, repaired_sha256`` of what ``repaired`` returns for whole conversations.

    SHA-256 needs a conversation's texts in order, so they pass one task, but only one batch of them is held.
    """
    return rows.mapInArrow(_digest, "conv_id bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = ["conv_id", "illegal", "cost", "audit", "repaired_sha256"], [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    legal = {"su", "ua", "au"}
    now, done = None, []

    def told():
        return (now["conv_id"], now["illegal"], now["cost"], "".join(now["audit"]), now["hash"].hexdigest())

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "edit", "old_role", "role", "text", "cost"))):
            conv_id, edit, old_role, role, text, cost = row
            if now is None or now["conv_id"] != conv_id:
                if now is not None:
                    done.append(told())
                now = {"conv_id": conv_id, "illegal": 0, "cost": 0, "audit": [], "hash": hashlib.sha256(), "last": None, "empty": True}
            if edit != "I":
                now["illegal"] += now["last"] is not None and now["last"] + old_role[:1] not in legal
                now["last"] = old_role[:1]
            if edit != "D":
                now["hash"].update(f"{'' if now['empty'] else chr(10)}{role}:{text}".encode())
                now["empty"] = False
            now["audit"].append(edit)
            now["cost"] += cost
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)
            done = []
    if now is not None:
        done.append(told())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)


def summary(found: DataFrame) -> DataFrame:
    """Per conversation of ``faults``: missing turns between the first and the last, and rows by fault."""
    turns = found.groupBy("conv_id", "turn").agg(*[F.count(F.when(F.col("fault") == k, 1)).alias(n) for k, n in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (TRUNCATED, "truncated"))])
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0).cast("bigint"))
    return turns.groupBy("conv_id").agg(gaps.alias("gaps"), *[F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated")])
