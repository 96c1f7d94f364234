"""Tables written between jobs, so that a lost executor costs no repeated work."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_steps: ContextVar[list[str] | None] = ContextVar("steps", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. A local session without that setting gets a
    temporary folder, any other session an error."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="spark-stage-"))
        top = _own[0]
    return top.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (open_ := _steps.get()) is not None:
        open_.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def steps(spark: SparkSession) -> Iterator:
    """Tables staged within this block are deleted at its end. It gives a function that
    stages a result, which stays (until an outer block ends). Blocks of several threads do
    not see each other."""
    mine: list[str] = []
    outer = _steps.set(mine)

    def keep(df: DataFrame, name: str) -> DataFrame:
        inner = _steps.set(outer.old_value if outer.old_value is not outer.MISSING else None)
        try:
            return stage(df, name)
        finally:
            _steps.reset(inner)

    try:
        yield keep
    finally:
        _steps.reset(outer)
        for path in mine:
            delete(spark, path)
