import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
#: Edge rows: nulls, empty and blank texts, a repeated row, equal texts, a very long text.
EDGES = [
    (None, "a row without an id, and with some words in it", "en", "src0", 10), (9000, None, None, None, None), (9001, "", "en", "src1", 0), (9002, " \n\t ", "en", None, 4),
    (9003, "the same few words again and again and again", "en", "src1", 44), (9003, "the same few words again and again and again", "en", "src1", 44),
    (9004, "The same few words AGAIN and again and again", "en", "src2", 44), (9005, "one", "en", "src2", 3), (9006, "é" * 5, "fr", "src2", 5),
    (9007, "word " * 60000 + "x" * 20000, "en", "src0", 320000), (9008, "日本語 のテキスト 😀 ﬁ", "ja", "src0", 15),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def edges(spark):
    """Edge rows with further columns whose names operators use themselves."""
    d = spark.createDataFrame(EDGES, SCHEMA)
    for name in ("n_words", "score", "copies", "size", "group", "held", "x", "run", "n", "kept", "h", "y", "_id", "component_id"):
        d = d.withColumn(name, F.lit("clash"))
    return d.cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet").cache()


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet").cache()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def text_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
