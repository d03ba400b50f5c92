"""Tables in the shared scratch folder, where lineage ends and a lost executor costs nothing that came before."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only on one machine, where the session names none, a
    local folder is made; on a cluster that is an error, since executors do not share their disks."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="siltstone-")
    return _OWN[app]


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the scratch folder and read back."""
    path = f"{root(df.sparkSession)}/siltstone/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
