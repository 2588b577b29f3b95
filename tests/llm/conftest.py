import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and blank texts, one very long text, repeated rows and ids, and columns with names that
    operators use themselves."""
    long_text = " ".join(f"word{i % 977}x{i}" for i in range(60_000))
    rows = [
        (1, "the same words of a short text that is here twice", "en", "a"),
        (2, "the same words of a short text that is here twice", "en", "a"),
        (2, "the same words of a short text that is here twice", "en", "a"),
        (3, None, None, None),
        (4, "", "en", "b"),
        (5, " \n\t ", "en", "b"),
        (6, "one", "en", "b"),
        (7, "One", None, "b"),
        (8, long_text, "en", "c"),
        (None, "nobody's text with a few words of its own in it", "en", "c"),
        (None, None, None, None),
        (9, "ünïcödé ſtrange ﬁ 漢字 İ  zero​width \x1c sep", "xx", "c"),
    ]
    df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], DOCS)
    return df.withColumns({c: F.lit("clash") for c in ("fp", "key", "id", "host", "score", "rank", "salt", "h", "toxic", "text_key", "component_id", "blocks", "start", "length")})


@pytest.fixture(scope="session")
def none(messy):
    return messy.limit(0)
