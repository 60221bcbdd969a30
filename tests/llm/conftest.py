import pytest

from talentgrid.llm.common import ship_package


@pytest.fixture(autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture
def docs_of(spark):
    """A documents table with columns whose names clash with the operators' own."""
    def make(rows):
        clash = ", id long, own string, key string, a string, n long, removed string, w string, label string"
        return spark.createDataFrame([(*r, 1, "x", "k", "a", 5, "r", "w", "l") for r in rows], f"doc_id long, text string{clash}")
    return make
