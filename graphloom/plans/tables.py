"""Writing intermediate tables to the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    path = spark.conf.get("spark.checkpoint.dir", None) or _own.get(app)
    if not path:
        path = _own[app] = "file://" + tempfile.mkdtemp(prefix="graphloom-")
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table on its own, with no lineage behind it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
