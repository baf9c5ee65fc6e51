"""Tables that are written once and read again: indexes, and replies that nobody wants to ask for twice."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


@atexit.register
def _clean() -> None:
    for path in _OWN:
        shutil.rmtree(path, ignore_errors=True)


def folder(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir, which executors share; on one machine without it, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="vellumspark-work-"))
        root = f"file://{_OWN[0]}"
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df, written and read again: it is computed once, and outlives the executors that computed it."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
