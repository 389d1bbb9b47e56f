"""Small tables with the awkward rows that every operator must stand."""

from pyspark.sql import functions as F

LONG = "lorem ipsum dolor " * 20_000 + "unbroken" * 5_000
WORDS = " ".join(f"word{k % 97} and{k % 13} tail{k}" for k in range(60))
ROWS = [
    (1, WORDS, "en", "src1", 100), (2, WORDS, "en", "src1", 100), (3, WORDS + " changed", "en", "src2", 110), (3, WORDS + " changed", "en", "src2", 110),
    (4, None, "en", "src1", None), (5, "", None, "src3", 0), (6, " \n\t ", "fr", None, 4), (None, "no id here", "de", "weird", 10), (7, LONG, "en", "src0", len(LONG)),
    (8, "Ünïcödé – 漢字 🎉 ß İ Σ", "de", "src9", 20), (9, "one", None, None, None), (10, "\x00\x1c odd\x85bytes", "es", "", 9),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, rows=ROWS):
    docs = spark.createDataFrame(rows, SCHEMA)
    # names that operators use inside
    return docs.withColumns({c: F.lit("clash") for c in ("fp", "node", "key", "root", "h", "n", "w", "rule", "score", "__tag", "domain", "Epoch", "item", "unit", "bucket", "print", "_print", "of_id", "copies", "round", "own_lang", "spans", "doc_key", "bad_key", "low", "words", "text_len", "held_out", "counts", "kind", "size", "held", "s", "q")})


def empty(spark):
    return documents(spark).where("false")
