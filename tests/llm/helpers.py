"""Documents with everything that is odd about documents."""

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, file string, at int, shard int, slot string, "
    "kept string, score string, lines string, n string, gone string, words string, node string, size string, rank string, taken string"
)

PROSE = {
    "en": "The quick brown fox jumps over the lazy dog while the farmer watches from the old wooden gate {0} and thinks about supper {1}",
    "de": "Der schnelle braune Fuchs springt über den faulen Hund, während der Bauer am alten Holztor {0} steht und an das Abendbrot {1} denkt",
    "fr": "Le renard brun et rapide saute par-dessus le chien paresseux pendant que le fermier {0} regarde près de la vieille porte {1}",
}


def row(doc_id, text, lang=None, source=None):
    return (doc_id, text, lang, source, len(text or ""), "r", "f", 1, 2, "s", "k", "sc", "l", "n", "g", "w", "nd", "z", "rk", "t")


def odd_rows():
    rows = [row(i, PROSE[lang].format(i * 7919, "x" * (i % 5)), lang, f"s{i % 3}" if i % 7 else None) for i in range(30) for lang in ["en", "de", "fr"][i % 3 : i % 3 + 1]]
    long = " ".join(f"word{i * i % 1009}{'é' if i % 50 == 0 else ''}" for i in range(60_000))
    rows += [row(100, None, "en", "s0"), row(101, "", None, None), row(102, " \t\n ", "de", ""), row(103, "12 345 %%", "fr", "s1")]
    rows += [row(104, long, "en", "s1"), row(105, "short", "en", "s2"), row(None, "no id here at all in this row", "en", "s2"), row(106, "\n\n", None, "s9")]
    # Repeated rows, and one id with two texts.
    rows += [row(3, PROSE["en"].format(3 * 7919, "xxx"), "en", "s0")] * 3 + [row(5, "another text under the same number", "en", "s1")]
    return rows


def odd_documents(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def stored(df, folder):
    path = str(folder / "documents.parquet")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
