import pytest

#: Columns that no operator may trip over: names it uses inside, or that its results have.
EXTRA = ("rules", "score", "key", "size", "seed", "spans", "n", "token", "cluster", "begin", "y", "kept", "range", "shard", "a", "b", "n_words", "ids", "row", "m", "v", "f", "again", "id", "s", "sig", "_sig", "_again", "_s", "_id", "_c", "__m", "__rules", "__lang", "__source", "__m_symbols", "_key", "head", "sets", "item", "one", "first", "parts", "members", "lines", "cuts", "form", "h")


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source), with extra columns on request."""

    def build(rows, extra=False):
        full = [(*r, *("en", "s")[len(r) - 2 :])[:4] if len(r) < 4 else r for r in rows]
        full = [(r[0], r[1], r[2], r[3], None if r[1] is None else len(r[1])) for r in full]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
        from pyspark.sql import functions as F

        return df.select("*", *[F.lit(7).alias(c) for c in EXTRA]) if extra else df

    return build


@pytest.fixture(scope="session")
def odd(make):
    """Nulls everywhere, empty and very long texts, repeated rows, clashing columns."""
    long = " ".join(f"w{i}" for i in range(30_000))
    one_word = "x" * 120_000
    return make([(1, None, None, None), (2, ""), (3, "   \n\t "), (None, "text without an id " * 20, None, "s"), (5, long), (6, one_word), (7, "same text"), (7, "same text"), (8, "same text"), (9, "é日本 😀 a\x00b")], extra=True)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
