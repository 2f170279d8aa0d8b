"""The pipeline, stage by stage, against what each stage promises."""

from collections import Counter

import corpus_pipeline
import pytest
from helpers import PROSE, no_documents, odd_documents, row
from test_dedup import expected

from rowloom.llm.common import written


def copies(spark):
    rows = [row(i, " ".join(f"{w}{i}" for w in PROSE[lang].format(i, "x").split() * 4), lang, f"s{i % 4}") for i in range(40) for lang in ["en", "de", "fr"][i % 3 : i % 3 + 1]]
    rows += [row(100 + i, rows[i][1].replace("Fuchs", "Wolf", 1), "de", "s9") for i in range(5)] + [row(200 + i, rows[7][1].upper(), "de", "s0") for i in range(15)]
    return rows


def test_stages(spark, tmp_path):
    rows = copies(spark)
    df = spark.createDataFrame(rows, odd_documents(spark).schema)
    spark.createDataFrame([(1, " ".join(rows[9][1].split()[3:40]))], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, str(tmp_path)), name)
        seen[name] = docs
        if name != "shards":
            assert docs.columns == df.columns
    assert seen["language"].count() == len(rows)
    kept = {r["doc_id"] for r in seen["near_copies"].collect()}
    assert kept == {c for (i, n, c) in expected([(r[0], r[1]) for r in rows], 5)}
    assert kept - {r["doc_id"] for r in seen["test_items"].collect()} == {9}
    times = Counter(r["doc_id"] for r in seen["sources"].collect())
    assert max(times.values()) <= 3 and set(times) <= kept
    assert Counter(r["doc_id"] for r in seen["shards"].collect()) == times
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(r["doc_id"] for r in whole.collect()) == times and {"shard", "slot"} <= set(whole.columns)


@pytest.mark.parametrize("make", [odd_documents, no_documents])
def test_odd_documents_pass(spark, tmp_path, make):
    spark.createDataFrame([(None, None), (1, "")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    make(spark).write.parquet(str(tmp_path / "documents.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert (found.count() > 0) == (make is odd_documents)
