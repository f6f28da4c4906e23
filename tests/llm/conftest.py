import pytest

from revsift.llm.common import prepare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session", autouse=True)
def prepared(spark):
    prepare(spark)


@pytest.fixture(scope="session")
def documents(spark):
    """The documents, and rows that are hard: null id, null and empty texts, a repeated row, a long text, clashing columns."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    long_text = " ".join(f"word{i % 977}" for i in range(30_000))
    odd = spark.createDataFrame(
        [(900_001, None, "en", "s"), (900_002, "", None, None), (None, "a row without an id, but with words", "en", "s"), (900_003, " \t\n ", "en", "s"),
         (900_004, "twice the same row", "en", "s"), (900_004, "twice the same row", "en", "s"), (900_005, long_text, "en", "s"),
         (900_006, "\x01marks\x02 in \x01text\x02 of a.b@c.de \U0001f600 x@y.zz", "en", "s")], docs.schema)
    return docs.unionByName(odd).repartition(3).cache()


@pytest.fixture(scope="session")
def texts(documents):
    return [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
