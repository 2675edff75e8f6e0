import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tagloom.llm.texts import prepare

LONG = "word " * 40_000 + "end"
ROWS = [
    (1, "Alpha beta gamma", "en"), (2, "Alpha  beta\ngamma", "en"), (3, None, None), (4, "", "fr"), (5, " \t\n", None),
    (6, LONG, "en"), (6, LONG, "en"), (None, "Alpha beta gamma", "de"), (7, "é ü 漢字 😀", None), (8, "12345 !!", "en"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows and extra columns that operators use inside."""
    prepare(spark)
    names = ["key", "row", "digest", "n", "hit_key", "_text", "print", "label", "kept"]
    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType())]
                        + [StructField(n, StringType()) for n in names])
    return spark.createDataFrame([(*r, *names) for r in ROWS], schema)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.filter("1 = 0")
