import pytest
from llm_cases import CLASHING, DOCUMENT, edge_rows
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(edge_rows(), DOCUMENT).repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENT)


@pytest.fixture(scope="session")
def clashing(spark):
    rows = spark.createDataFrame(edge_rows(), DOCUMENT)
    return rows.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (2, 1, 0), (5, 0, 0), (8, 0, None), (7, None, 0), (None, 1, 0), (99, 0, 0)],
        "doc_id long, quality int, toxic int",
    )
