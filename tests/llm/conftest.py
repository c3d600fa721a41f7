import pytest
from pyspark.sql import SparkSession

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (doc_id, text) -> a documents table, with columns that operators might use themselves."""

    def make(rows, source="s"):
        data = [(i, t, "en", source if isinstance(source, str) else source(i), None if t is None else len(t), 1, 2, 3, 4) for i, t in rows]
        clash = ", size int, shard int, n int, label int"
        return spark.createDataFrame(data, DOCS + clash)

    return make
