import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASH = ["size", "score", "block", "h", "k", "kept", "base", "bands", "row", "id", "n", "rank", "spans"]


@pytest.fixture(scope="session")
def make(spark):
    """Rows (doc_id, text[, source[, lang]]) → documents with further columns of clashing names."""
    from pyspark.sql import functions as F

    def build(rows):
        full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, SCHEMA).repartition(3)
        return df.select("*", *[F.lit(1).alias(c) for c in CLASH])

    return build


LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
#: Null and empty texts, blanks only, a very long text, ties, repeated rows, a null id.
EDGES = [
    (1, None), (2, ""), (3, " \t\n "), (4, LONG), (5, "same words here for all of us"), (6, "same words here for all of us"),
    (7, "one"), (7, "one"), (8, "é" * 40 + " ́x 日本語 😀"), (9, "a  b   c\td\r\ne f g h"), (None, "no id at all in this row"),
]


@pytest.fixture(scope="session")
def edges(make):
    return make(EDGES)


@pytest.fixture(scope="session")
def empty(make, spark):
    return make([(0, "x")]).filter("doc_id > 5")
