import pytest

SF = "/root/testdata/sf0.001"
#: What every text operator must take: nulls anywhere, empty and long texts, ties, repeats.
ODD = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "s1", 10),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "s1", 10),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "s1", 10),
    (3, None, None, None, None),
    (4, "", "en", "s2", 0),
    (5, " \t\n\x0b\x0c\r ", "en", "s2", 7),
    (None, "no id here but words enough to make a shingle or two", None, "s1", 3),
    (None, "no id here but words enough to make a shingle or two", None, "s1", 3),
    (6, "one two", "en", None, 7),
    (7, "w " * 60_000, "en", "s3", 120_000),
    (8, "É " + " ".join(f"word{i}" for i in range(3_000)) + "\nline of some length\nline of some length", "fr", "s3", 9),
    (9, "line of some length\nLINE OF SOME LENGTH \nshort", "fr", "s4", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


#: Names of columns that operators make on their way, or as results.
CLASHING = ("count", "key", "part", "h", "d", "r", "s", "item", "tie", "_tie", "_r", "_c", "_n", "_times", "_again", "_d", "_kinds", "kinds", "found", "drop", "_drop", "_text", "n_lines", "N_DROPPED", "_spans", "n_cut", "_found", "shard", "_rows", "_nodes", "_node", "_salt", "node", "row", "_w")


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows, with columns whose names clash with those that operators make; each says whose
    row and which column it was."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, SCHEMA)
    return df.select("*", *[F.concat(F.lit(f"{c}/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in CLASHING])


def unharmed(df, rows=None):
    """Every clashing column has its own name's and row's value still."""
    got = df.select("doc_id", *[f"`{c}`" for c in CLASHING]).collect()
    for r in got:
        assert r[1:] == tuple(f"{c}/{'none' if r.doc_id is None else r.doc_id}" for c in CLASHING), r
    assert rows is None or len(got) == rows
    return got


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
