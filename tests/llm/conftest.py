import pytest


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from tabsmith.llm.common import ship_code

    ship_code(spark)


@pytest.fixture
def docs(spark):
    """Documents from tuples (doc_id, text) or (doc_id, text, lang), split over several partitions."""

    def make(rows, parts=3):
        full = [(*r, *[None] * (3 - len(r))) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string").repartition(parts)

    return make
