"""Queries that judge each text by itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.llm.byte_cnn import held_out, identify, train
from rowloom.llm.pseudo_likelihood import score
from rowloom.llm.queries import query, table
from rowloom.llm.secret_novelty import find_secrets


@query("op5_pseudo_likelihood")
def op5(spark, folder):
    return score(table(spark, folder, "documents"))


@query("op8_byte_cnn")
def op8(spark, folder):
    documents = table(spark, folder, "documents")
    marked = identify(documents.select("doc_id", "text"), train(documents))
    return marked.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


@query("op10_secret_novelty")
def op10(spark, folder):
    found = find_secrets(table(spark, folder, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "novel")
    counts = [count(kind) for kind in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
