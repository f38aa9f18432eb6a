"""Small inputs with the cases every operator must define: nulls in any column, empty and
long texts, ties, repeated rows, and extra columns whose names clash with internal ones."""

LONG = "word " * 30_000 + "x" * 20_000
A = "the quick brown fox jumps over the lazy dog and runs far away from here today"
ROWS = [
    (1, A, "en", "s1"),
    (2, A.replace(" ", "\n"), "en", "s1"),
    (3, A + " again", "en", "s2"),
    (4, None, "en", "s2"),
    (5, "", None, None),
    (6, " \t\n", "en", "s3"),
    (7, LONG, "en", "s3"),
    (8, "short text", "en", "s1"),
    (8, "short text", "en", "s1"),
    (9, "Short  Text", "en", "s1"),
    (None, "no id here", "en", "s1"),
    (10, "naïve 😀   text\x00 with odd ▁ signs", "fr", "s2"),
]
EXTRA = ["_n", "n", "_key", "size", "digest", "tokens", "text_sha256", "target", "removed", "component", "ids", "score", "_id", "kept"]


def docs(spark, rows=None):
    d = spark.createDataFrame(ROWS if rows is None else rows, "doc_id long, text string, lang string, source string")
    return d.selectExpr("*", *[f"'x' AS `{c}`" for c in EXTRA])


def rows_of(df, *cols):
    return sorted([tuple(r) for r in df.select(*cols).collect()], key=repr)
