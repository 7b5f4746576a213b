import duckdb
import pytest

from grainwise.llm.common import ready

FOLDER = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "labels")


@pytest.fixture(scope="session")
def llm(spark):
    """The session with the settings that the operators ask for."""
    ready(spark)
    return spark


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def frame(spark, texts, **extra):
    """Documents with columns whose names the operators use inside."""
    names = ["score", "n", "ids", "task", "part", "copies", "left", "y", "component_id"]
    rows = [(i, t, *[j for j, _ in enumerate(names)]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"`{n}` int" for n in names))


EDGES = [
    None, "", " ", "\n\t ", "a", "Apache License", "x" * 40_000, "ab " * 9_000, "It's   we'll 'RE \x1c\x1d b c", "日本語 テキスト 🎉🎉 é é",
    "call +1 (499) 555-6503 or a.b@mail.example.com", "<|endoftext|> 1234567890", "same text", "same text",
]
