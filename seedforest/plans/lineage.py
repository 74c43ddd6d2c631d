"""Cutting lineage: tables in the shared checkpoint folder, written once and read back."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which driver and executors share. Only a session whose master is in this very process may do without one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named:
            if not context.master.startswith("local[") and context.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = f"{context.getConf().get('spark.local.dir', '/tmp')}/seedforest-{uuid.uuid4().hex}"
        context.setCheckpointDir(named)
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df written once, as a table in the shared folder, and read back, so that later jobs and lost executors start from files, and the planner from
    the sizes of these files (checkpoint() keeps its estimates, which grow with every join of a loop). The tables go with drop(), the rest when Python exits."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[path] = spark
    out.cut_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(*tables: DataFrame) -> None:
    """Deletes tables made by cut() that nothing reads any more."""
    for table in tables:
        spark = _written.pop(table.cut_path, None)
        if spark is not None:
            _delete(spark, table.cut_path)


@atexit.register
def _clear() -> None:
    for path, spark in _written.items():
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session has ended before
            return
