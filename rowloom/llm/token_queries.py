"""Queries over token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from rowloom.llm.queries import query, table
from rowloom.llm.token_files import round_trip


@query("op11_simple8b")
def op11(spark, folder):
    read = round_trip(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
