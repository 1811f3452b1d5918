import pytest

LONG = " ".join(f"wort{i % 977} the{i % 13} Ünd" for i in range(30_000))

#: Null ids and texts, empty and blank texts, a very long one, ties, repeated rows; columns named as operators name theirs.
EDGE = [
    (None, "a null id has a text of its own, of ten words"), (None, None), (1, None), (2, ""), (3, " \t\n "), (4, LONG),
    (5, "one two three four five six seven"), (5, "one two three four five six seven"), (6, "one two three four five six seven"),
    (7, "word"), (8, "WORD"), (9, "ein zwei  drei\n\nvier é fünf token=abcdef12 "), (9, "another text of the same document id"),
]


@pytest.fixture(scope="session")
def llm_spark(spark):
    from corpusflow.llm.common import prepare

    return prepare(spark)


@pytest.fixture(scope="session")
def edge(llm_spark):
    rows = [(i, t, "kept", 0.5, 1, "x", "y") for i, t in EDGE]
    return llm_spark.createDataFrame(rows, "doc_id long, text string, kept string, score double, component_id int, spans string, rank string")


@pytest.fixture(scope="session")
def nothing(llm_spark):
    return llm_spark.createDataFrame([], "doc_id long, text string, kept string, score double, component_id int, spans string, rank string")


@pytest.fixture(scope="session")
def documents(llm_spark, sf):
    return llm_spark.read.parquet(f"{sf}/documents.parquet")
