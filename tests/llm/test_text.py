"""Language, secrets and language-model scores against brute force and held-out texts."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import PROSE, no_documents, odd_documents, odd_rows

from rowloom.llm import byte_cnn, pseudo_likelihood, secret_novelty
from rowloom.llm.common import mix
from rowloom.llm.byte_cnn import accepted, held_out, identify, train
from rowloom.llm.pseudo_likelihood import score
from rowloom.llm.secret_novelty import find_secrets

WORDS = {
    "en": "the and of that with from have this which their would there about other people because through between",
    "de": "und der die das nicht ein eine auch nach über wird können zwischen während durch müssen größer straße",
    "fr": "le la les des une dans pour avec être après depuis entre même où ça très qu'il c'est élève naïve",
}


def sentence(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n))


def labelled(spark, count=240, noise=False):
    rng = random.Random(1)
    langs = sorted(WORDS)
    rows = [(i, sentence(rng, langs[i % 3], rng.choice([8, 40, 300])), langs[i % 3]) for i in range(count)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_held_out_accuracy(spark):
    docs = labelled(spark)
    model = train(docs)
    assert model[0] == ["de", "en", "fr"]
    found = identify(docs.withColumn("held", held_out("doc_id")).drop("lang"), model).collect()
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    out = [r for r in found if r["held"]]
    assert len(out) > 30 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in out) >= 0.97 * len(out)
    assert all(1 / 3 <= r["score"] <= 1 for r in found)


def test_held_out_rows_and_other_columns_teach_nothing(spark):
    docs = labelled(spark)
    wrong = docs.withColumn("lang", held_out("doc_id").cast("string"))
    assert train(wrong)[0] == ["false"]
    a, b = train(docs.union(docs)), train(docs.filter(~held_out("doc_id")).selectExpr("*", "'x' AS source"))
    assert a[0] == b[0] and all(np.allclose(a[1][k], b[1][k]) for k in a[1])


def test_tables_say_what_the_network_says():
    network = byte_cnn.Network(3)
    rows = byte_cnn.windows("Größer als der alte Wagen 12 ".encode() * 20)
    p, embedded, pooled = network.p, network.p["e"][rows], []
    for w in byte_cnn.WIDTHS:
        parts = np.concatenate([embedded[:, j : byte_cnn.WINDOW - w + 1 + j] for j in range(w)], axis=2)
        pooled.append(np.maximum((parts @ p[f"f{w}"] + p[f"c{w}"]).max(1), 0))
    want = byte_cnn.softmax(np.concatenate(pooled, axis=1) @ p["w"] + p["b"])
    judge = byte_cnn.Judge(p)
    assert np.allclose(judge.chances(rows), want, atol=1e-5)
    texts = [b"", b"short", b"long one " * 30_000]
    whole = [byte_cnn.softmax(np.zeros((1, 3)))[0] * 0 + judge.chances(byte_cnn.windows(t)).mean(0) for t in texts]
    assert np.allclose(judge.texts(texts), whole, atol=1e-6)


def test_gradient_of_the_byte_network():
    network, rng = byte_cnn.Network(2), np.random.default_rng(0)
    data, labels = byte_cnn.windows(b"some words to learn from " * 20), np.array([0, 1] * 2)
    network.p["w"] = rng.normal(0, 0.3, network.p["w"].shape)
    grads = network._gradient(data, labels)

    def loss():
        embedded, pooled = network.p["e"][data], []
        for w in byte_cnn.WIDTHS:
            parts = np.concatenate([embedded[:, j : byte_cnn.WINDOW - w + 1 + j] for j in range(w)], axis=2)
            pooled.append(np.maximum((parts @ network.p[f"f{w}"] + network.p[f"c{w}"]).max(1), 0))
        chance = byte_cnn.softmax(np.concatenate(pooled, axis=1) @ network.p["w"] + network.p["b"])
        return -np.log(chance[np.arange(len(labels)), labels]).mean()

    for name, at in (("w", (3, 1)), ("f3", (5, 2)), ("c2", (1,)), ("e", (ord("o"), 3)), ("b", (0,))):
        kept = network.p[name][at]
        network.p[name][at] = kept + 1e-5
        more = loss()
        network.p[name][at] = kept - 1e-5
        less = loss()
        network.p[name][at] = kept
        assert grads[name][at] == pytest.approx((more - less) / 2e-5, abs=1e-6)


def test_language_of_odd_documents(spark):
    docs = odd_documents(spark)
    found = identify(docs, train(docs))
    assert found.columns == [*(c for c in docs.columns if c != "score"), "lang_pred", "score"]
    by = {(r["doc_id"], r["text"]): r for r in found.collect()}
    assert all(by[k]["lang_pred"] == "und" and by[k]["score"] == 0 for k in by if not re.search(r"[^\W\d_]", k[1] or ""))
    assert found.count() == len(odd_rows()) and by[1, PROSE["de"].format(7919, "x")]["lang_pred"] == "de"
    kept = accepted(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in kept.collect()} == {100, 101, 102, 103, 106}
    nothing = identify(no_documents(spark), train(no_documents(spark)))
    assert nothing.count() == 0 and {r["lang_pred"] for r in identify(docs, ([], {})).collect()} == {"und"}
    assert accepted(no_documents(spark)).count() == 0


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(found)]


PIECES = ["password", "PassWD", "sEcret", "token", "apikey", "API_key", "=", ":", " ", "  ", '"', "'", "AKIA", "AKIAAKIA", "ABCD1234EFGH5678", "é", "ſecret", "toKen", "\n", "abcdef", "deadbeef", "0123456789", "x", "a+b/c_=", "\t", "漢"]


def test_base_spans(spark):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice(PIECES) for _ in range(rng.randrange(0, 40)))) for i in range(1500)] + [(None, "token=abcdef"), (9000, None), (9001, ""), (9001, "")]
    found = find_secrets(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    mine = Counter((r["doc_id"], tuple((s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] != "novel")) for r in found)
    assert mine == Counter((i, tuple(base(t or ""))) for i, t in rows)
    assert all([(s["start"], secret_novelty.KINDS.index(s["kind"])) for s in r["spans"]] == sorted((s["start"], secret_novelty.KINDS.index(s["kind"])) for s in r["spans"]) for r in found)


def test_novel_strings_are_told_from_known_ones(spark):
    rng = random.Random(9)
    random_text = "".join(rng.choice("ABCDEFGHJKMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz23456789") for _ in range(32))
    prose = "Nothing to see in this line of plain prose. " * 5
    composed = "customerAccountRepositoryFactoryBean2"
    rows = [(i, f"{prose} import {composed} and customerAccountRepositoryFactory1 here") for i in range(20)]
    rows += [(100, f"é {prose} the auth header is {random_text} as sent"), (101, f"{prose} unrelated {random_text} here"), (102, f"{prose} auth with {composed} now")]
    rows += [(103, f"auth {random_text} again {random_text} and the key is {random_text}")]
    found = {r["doc_id"]: r["spans"] for r in find_secrets(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [(s["kind"], rows[20][1][s["start"] : s["end"]]) for s in found[100]] == [("novel", random_text)]
    assert not found[101] and not found[102] and not found[3]
    # Copies do not hide each other.
    assert [rows[23][1][s["start"] : s["end"]] for s in found[103]] == [random_text] * 3


@pytest.mark.parametrize("apart", [1, 20, 490, 530, 1000])
def test_copies_of_a_secret_are_all_reported(spark, apart):
    rng = random.Random(apart)
    secret = "".join(rng.choice("ABCDEFGHJKMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz23456789") for _ in range(40))
    gap = ("nothing to see " * 80)[:apart]
    composed, prose = "customerAccountRepositoryFactoryBean2", "Nothing to see in this line of plain prose. " * 5
    rows = [(n, f"auth: {gap.join([f' {secret} '] * n)}") for n in (1, 2, 3)] + [(10 + i, f"{prose} auth with {composed} now. " * 3) for i in range(20)]
    found = {r["doc_id"]: r["spans"] for r in find_secrets(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for n in (1, 2, 3):
        assert [rows[n - 1][1][s["start"] : s["end"]] for s in found[n]] == [secret] * n
    assert not any(found[10 + i] for i in range(20))


def test_novel_spans_equal_plain_compression():
    """Each string against the text around it, compressed with and without it, copies cut out by hand."""
    rng = random.Random(12)
    pool = ["".join(rng.choice("ABCDEFGHabcdefgh2345") for _ in range(rng.randrange(14, 40))) for _ in range(12)]
    words = pool + ["key", "auth", "the", "of", "signature", "plain", "0123456789abcdef01", "aaaaaaaaaaaaaaaaaaaaaaa1"]
    member, novelty = secret_novelty.members_of(secret_novelty.TOKEN_BYTES), secret_novelty.Novelty(b"plain signature common words")
    for _ in range(150):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 120))).encode()
        places = secret_novelty.candidates(text, member)
        novel = set()
        for a, b in places:
            low, high, word = max(0, a - 512), min(len(text), b + 512), text[a:b]
            hidden = np.zeros(len(text), bool)
            at = text.find(word)
            while at >= 0:
                hidden[at : at + len(word)] = True
                at = text.find(word, at + len(word))
            around = bytes(x for i, x in enumerate(text[low:high], low) if not hidden[i])
            bits = 8 * (len(novelty.packer.compress(around + word)) - len(novelty.packer.compress(around))) / len(word)
            if bits >= 3.5 and re.search(rb"key|auth|signature", text[max(0, a - 48) : a]):
                novel.add(word)
        assert secret_novelty.novel_spans(text, member, novelty, []) == [(a, 3, b) for a, b in places if text[a:b] in novel]


def test_names_and_values_of_assignments_are_told_apart(spark):
    rng = random.Random(10)
    value = "".join(rng.choice("ABCDEFGHJKMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz23456789") for _ in range(32))
    forms = ["export AWS_SECRET_ACCESS_KEY={}", "STRIPE_KEY={}", "see https://a.example/x?auth={}&page=2", "STRIPE_KEY = {}", "SIGNING_KEY={}==", "a=1=auth={}.", "COLOUR={}", "=={}"]
    rows = [(i, form.format(value) + "\n") for i, form in enumerate(forms)]
    found = {r["doc_id"]: [(s["kind"], rows[r["doc_id"]][1][s["start"] : s["end"]]) for s in r["spans"]] for r in find_secrets(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found == {i: [("novel", value + "==" * (i == 4))] if i < 6 else [] for i in range(8)}


def test_secrets_in_odd_documents(spark):
    found = find_secrets(odd_documents(spark)).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in odd_rows()) and not any(s["kind"] != "novel" for r in found for s in r["spans"])
    assert find_secrets(no_documents(spark)).count() == 0


def plain_ways(counts, rows):
    """The way to each rank by plain recursion: (slot, cut's base value, whether right) from the root on."""
    before = np.concatenate(([0], np.cumsum(counts))).tolist()
    ways = {}

    def go(low, high, way):
        if high - low == 1:
            ways[low] = way
            return
        half = (before[low] + before[high]) // 2
        cut = min(range(low + 1, high), key=lambda c: (abs(before[c] - half), c))
        if len(way) < pseudo_likelihood.TOP:
            slot = int("1" + "".join(str(int(right)) for _, _, right in way), 2) - 1
        else:
            slot = pseudo_likelihood.TOP_NODES + int(mix(np.array([cut], np.uint64))[0]) % (rows - pseudo_likelihood.TOP_NODES)
        base = np.log((before[high] - before[cut]) / (before[cut] - before[low]))
        go(low, cut, [*way, (slot, base, False)])
        go(cut, high, [*way, (slot, base, True)])

    go(0, len(counts), [])
    return ways


def plain_log_chance(p, around, way):
    h = np.tanh(np.concatenate([p["e"][i] for i in around]).astype(float) @ p["w"].astype(float) + p["b"])
    values = [base + h @ p["u"][slot].astype(float) for slot, base, _ in way]
    return -sum(np.log1p(np.exp(-x if right else x)) for x, (_, _, right) in zip(values, way))


def some_tree(words, seed):
    rng = np.random.default_rng(seed)
    counts = np.sort(rng.zipf(1.4, words).clip(max=10**6))[::-1]
    n, size = np.unique(counts, return_counts=True)
    return pseudo_likelihood.Tree(n[::-1], size[::-1]), counts


@pytest.mark.parametrize("words", [1, 2, 3, 50, 3000])
def test_tree_is_a_distribution_over_all_words(words):
    tree, counts = some_tree(words, words)
    rows = pseudo_likelihood.table_rows(words)
    ways = plain_ways(counts, rows)
    paths = tree.paths(np.arange(words), rows)
    around = np.tile(np.array([[5, 0, 7, 4000]]), (words, 1))
    p = pseudo_likelihood.initial(rows)
    # Before anything is learned a word has its exact share of the counts.
    assert np.allclose(pseudo_likelihood.log_chance(p, around, paths), np.log(counts / counts.sum()), atol=1e-4)
    p["u"] = np.random.default_rng(2).normal(0, 1, p["u"].shape).astype(np.float32)
    found = pseudo_likelihood.log_chance(p, around, paths)
    assert np.exp(found).sum() == pytest.approx(1, abs=1e-4)
    assert np.allclose(found, [plain_log_chance(p, around[0], ways[r]) for r in range(words)], atol=1e-3)
    some = np.random.default_rng(3).integers(0, words, 200)
    assert np.allclose(pseudo_likelihood.log_chance(p, around[np.zeros(200, int)], paths.of(some)), found[some], atol=1e-5)


def test_gradient_of_the_tree():
    tree, _ = some_tree(3000, 4)
    rng = np.random.default_rng(5)
    rows = pseudo_likelihood.table_rows(3000)
    p = {k: v.astype(np.float64) for k, v in pseudo_likelihood.initial(rows).items()}
    p["u"] = rng.normal(0, 0.5, p["u"].shape)
    around, words = rng.integers(0, rows, (40, 4)), rng.integers(0, 3000, 40)
    paths = tree.paths(words, rows)
    found = {k: np.zeros_like(v) for k, v in p.items()}

    class Recorder(pseudo_likelihood.Learner):
        def _move(self, name, at, gradient):
            found[name][at] += gradient

    Recorder(p).step(around, paths)
    for name, own in p.items():
        touched = np.argwhere(found[name] != 0)
        for at in map(tuple, touched[rng.integers(0, len(touched), 12)]):
            kept, sides = own[at], []
            for change in (1e-5, -1e-5):
                own[at] = kept + change
                sides.append(-pseudo_likelihood.log_chance(p, around, paths).mean())
            own[at] = kept
            assert found[name][at] == pytest.approx((sides[0] - sides[1]) / 2e-5, rel=2e-2, abs=1e-6)


def test_nodes_are_cut_once_for_all_words_below_them(monkeypatch):
    tree, _ = some_tree(3000, 6)
    hashed = []
    monkeypatch.setattr(pseudo_likelihood, "mix", lambda x: hashed.append(len(x)) or mix(x))
    tree.paths(np.arange(3000), pseudo_likelihood.table_rows(3000))
    assert 0 < sum(hashed) < 3000  # the tree has 2,999 nodes


def test_repeated_rows_move_once_by_all_their_gradients():
    p = pseudo_likelihood.initial()
    learner, rng = pseudo_likelihood.Learner(p), np.random.default_rng(8)
    want, square = p["e"].astype(float), np.full(p["e"].shape, 1e-4)
    for size in (1, 700, 5000):
        rows, gradients = rng.integers(0, 300, size), rng.normal(0, 1, (size, pseudo_likelihood.EMBEDDING)).astype(np.float32)
        total = np.zeros(want.shape)
        np.add.at(total, rows, gradients)
        square += total**2
        want -= pseudo_likelihood.RATE * total / np.sqrt(square)
        learner._move_rows("e", rows, gradients)
        assert np.allclose(learner.p["e"], want, atol=1e-4)


def test_parts_of_long_texts_see_each_others_words(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(9)
    texts = [rng.integers(0, 9000, n).astype(pseudo_likelihood.TOKEN) for n in (0, 1, 3, 64, 65, 300, 0, 2)]
    given = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([t.tobytes() for t in texts], pa.binary())], names=["id", "tokens"])
    to_input, found = pseudo_likelihood.Inputs(4096), []
    monkeypatch.setattr(pseudo_likelihood, "BLOCK_WORDS", 64)
    for block in pseudo_likelihood.blocks(iter([given]), 4096):
        for some, (row, at), which in block.batches(10):
            found += zip([block.ids[i][0] for i in block.owner[some]], block.kinds[which].tolist(), row[at[:, None] + pseudo_likelihood.NEAR].tolist())
    want = []
    for name, t in enumerate(texts):
        inputs = [0, 0, *to_input[t].tolist(), 0, 0]
        want += [(name, word, [inputs[i], inputs[i + 1], inputs[i + 3], inputs[i + 4]]) for i, word in enumerate(t.tolist())]
    assert found == want


def test_scores_add_up_over_all_words(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["a b c d", "e f g h"]) for _ in range(rng.randrange(0, 60)))) for i in range(150)] + [(500, "a b c d " * 40_000), (None, "a b"), (501, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    tokens = pseudo_likelihood.pack_tokens(df, "doc_id", "text")
    model = pseudo_likelihood.train(tokens)
    p = pseudo_likelihood.unflat(model["values"])
    to_input = pseudo_likelihood.Inputs(len(p["u"]))
    packed = {r["id"]: np.frombuffer(r["tokens"], pseudo_likelihood.TOKEN) for r in tokens.collect()}
    counts = np.sort(np.bincount(np.concatenate(list(packed.values()))))[::-1]
    ways = plain_ways(counts, len(p["u"]))
    import pyarrow as pa

    given = pa.RecordBatch.from_arrays([pa.array(list(packed), pa.int64()), pa.array([x.tobytes() for x in packed.values()], pa.binary())], names=["id", "tokens"])
    found = [r for b in pseudo_likelihood._score(model)(iter([given])) for r in b.to_pylist()]
    assert [r["id"] for r in found] == list(packed)
    for r in found:
        t, want = packed[r["id"]], 0.0
        if r["id"] == 500:
            assert r["n_tokens"] == 160_000
        for at in range(len(t)) if len(t) < 300 else ():
            around = [to_input[t[at + j]] if 0 <= at + j < len(t) else pseudo_likelihood.PAD for j in (-2, -1, 1, 2)]
            want += plain_log_chance(p, around, ways[int(t[at])])
        assert len(t) >= 300 or r["log_prob"] == pytest.approx(want, rel=1e-3, abs=1e-3)


def test_order_matters_in_a_large_vocabulary(spark):
    """20,000 words, far more than tables have rows: nearly all texts score above their own words in another order."""
    rng = random.Random(17)
    phrases = [[f"w{i + j}" for j in range(4)] for i in range(0, 20_000, 4)]
    texts = [[w for _ in range(25) for w in rng.choice(phrases)] for _ in range(3000)]
    other = [rng.sample(t, len(t)) for t in texts[:200]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts + other)], "doc_id bigint, text string").coalesce(2)
    found = {r["doc_id"]: r["mean_log_prob"] for r in score(df).collect()}
    assert sum(found[i] > found[3000 + i] for i in range(200)) >= 190


def test_order_matters_to_the_score(spark):
    rng = random.Random(6)
    def text(n):
        return " ".join(rng.choice(["one two three four", "red green blue black", "up down left right"]) for _ in range(n))

    known = [(i, text(60)) for i in range(300)]
    asked = [(1000 + i, text(10)) for i in range(20)]
    shuffled = [(2000 + i, " ".join(rng.sample(t.split(), 40))) for i, (_, t) in enumerate(asked)]
    df = spark.createDataFrame(known + asked + shuffled, "doc_id bigint, text string").coalesce(2)
    found = {r["doc_id"]: r["mean_log_prob"] for r in score(df, rounds=3).collect()}
    assert all(found[1000 + i] > found[2000 + i] + 0.3 for i in range(20))


def test_every_word_has_its_own_count(spark):
    # More words than 16 bits tell apart.
    rows = [(i, " ".join([*(f"w{j}" for j in range(i * 1000, i * 1000 + 1000)), *["Often"] * 7, *["twice", "thrice"][: 1 + i % 2]])) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    tokens, spectrum = pseudo_likelihood.ranked_tokens(df, "doc_id", "text")
    want = Counter(w.lower() for _, t in rows for w in t.split())
    assert {r["n"]: r["words"] for r in spectrum.collect()} == Counter(want.values())
    texts, rank = dict(rows), {}
    for r in tokens.collect():
        for word, k in zip(texts[r["id"]].lower().split(), np.frombuffer(r["tokens"], pseudo_likelihood.TOKEN).tolist(), strict=True):
            assert rank.setdefault(word, k) == k
    assert sorted(rank.values()) == list(range(len(want)))
    tree = pseudo_likelihood.train(tokens)["tree"]
    words = sorted(rank, key=rank.get)
    share = np.array([want[w] for w in words]) / sum(want.values())
    paths = tree.paths(np.arange(len(words)), pseudo_likelihood.LEAST_ROWS)
    found = pseudo_likelihood.log_chance(pseudo_likelihood.initial(), np.zeros((len(words), 4), int), paths)
    assert np.allclose(found, np.log(share), atol=1e-4) and pseudo_likelihood.table_rows(10**8) == 80_000


def test_texts_without_words_have_no_score(spark):
    rows = [(1, ""), (2, None), (None, " \n")]
    found = score(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert Counter(tuple(r) for r in found) == Counter((i, 0, 0.0, None) for i, _ in rows)


def test_order_matters_to_the_registered_score(spark, tmp_path):
    from rowloom.llm.queries import QUERIES, load_all

    load_all()
    rng = random.Random(7)
    words = [f"w{i}" for i in range(200)]
    phrases = [words[i : i + 4] for i in range(0, 200, 4)]

    def text(n):
        return [w for _ in range(n) for w in rng.choice(phrases)]

    known, asked = [text(100) for _ in range(3000)], [text(40) for _ in range(20)]
    texts = known + asked + [rng.sample(t, len(t)) for t in asked]
    spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["doc_id"]: r["mean_log_prob"] for r in QUERIES["op5_pseudo_likelihood"](spark, str(tmp_path)).collect()}
    assert all(found[3000 + i] > found[3020 + i] + 0.3 for i in range(20))


def test_scores_of_odd_documents(spark):
    found = score(odd_documents(spark)).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in odd_rows())
    by = {r["doc_id"]: r for r in found}
    assert by[100]["n_tokens"] == by[101]["n_tokens"] == 0 and by[100]["log_prob"] == 0 and by[100]["mean_log_prob"] is None
    assert by[104]["n_tokens"] == 60_000 and by[104]["log_prob"] < 0
    assert score(no_documents(spark)).count() == 0
