import pytest
from texts import edge_texts


@pytest.fixture(scope="session")
def edge_docs(spark):
    """The edge texts as documents: repeated rows, null ids and columns with names that results might use."""
    rows = [(i, t, ["a", "b", None, "c"][i % 4], "x") for i, t in enumerate(edge_texts())]
    rows += [rows[6], (None, "no id here", None, None), (None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, `block` string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, `block` string")
