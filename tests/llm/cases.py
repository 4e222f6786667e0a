"""Documents with the odd rows that every operator must take, and a table with clashing columns."""

WORDS = "the river ran past old mills and the town where people met to talk of trade".split()
TEXTS = [
    (1, " ".join(WORDS * 6), "en", "a"), (2, " ".join(WORDS * 6), "en", "a"), (3, None, None, None), (4, "", "en", "b"),
    (5, " \n\t ", "fr", None), (None, "no id here, only text", "en", "b"), (7, "café déjà vu 123 !!", None, "c"),
    (8, "x", "de", "c"), (9, " ".join(f"w{i}" for i in range(30_000)), "en", "a"), (1, " ".join(WORDS * 6), "en", "a"),
    (11, "same line\nsame line\nother\nsame line", "en", "d"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use inside or for their results.
CLASH = ("size", "words", "score", "fp", "row", "uid", "stats", "copies", "block", "spans", "ids", "rank", "key", "lines")


def documents(spark, rows=TEXTS):
    return spark.createDataFrame([(*r, len(r[1]) if r[1] else 0) for r in rows], SCHEMA)


def clashing(docs):
    from pyspark.sql import functions as F

    return docs.withColumns({name: F.lit("clash") for name in CLASH})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
