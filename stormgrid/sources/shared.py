"""Steps written to the folder that executors and driver share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local session may leave it unset; it gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _LOCAL.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-"))


def written(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder, in a folder for each value of ``by``, and read it back, which cuts its lineage."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    (df.write if by is None else df.write.partitionBy(by)).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def dropped(*steps: DataFrame) -> None:
    """Delete tables that ``written`` made and nothing reads any more."""
    for df in steps:
        path = getattr(df, "written_at", None)
        if path is not None:
            session = df.sparkSession
            where = session._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
