"""Small tables with the awkward cases: nulls everywhere, empty and long texts, ties, repeated rows, clashing names."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, id long, row_key string, sha string"

AWKWARD = [
    (1, "the cat sat on the mat and the dog ran off", "en", "a", 10, 0.1, 9, "x", "s"),
    (2, None, None, None, None, None, None, None, None),
    (3, "", "en", "b", 0, 0.2, 9, "x", "s"),
    (4, " \t\n", "de", "b", 3, 0.2, 9, "x", "s"),
    (5, "the cat sat on the mat and the dog ran off", "en", "a", 10, 0.1, 9, "x", "s"),
    (5, "the cat sat on the mat and the dog ran off", "en", "a", 10, 0.1, 9, "x", "s"),
    (None, "a text without an id", "en", "c", 5, None, None, None, None),
    (None, None, None, None, None, None, None, None, None),
    (6, "der hund und die katze", "de", None, 5, 0.0, 1, "y", "t"),
    (7, "word " * 60_000, "en", "long", 300_000, 0.0, 1, "y", "t"),
    (8, "été \U0001f600 1234 　 naïve text", "fr", "a", 5, 0.0, 1, "y", "t"),
]


def awkward(spark):
    return spark.createDataFrame(AWKWARD, DOCS).repartition(3)


def nothing(spark):
    return spark.createDataFrame([], DOCS)
