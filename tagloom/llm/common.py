"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where the cluster names none, a local
    session gets a temporary folder and any other session an error."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="spark-stage-")
    return f"file://{_own_dir}"


@contextmanager
def shuffles_given_up(spark: SparkSession):
    """Within this block each execution deletes its shuffle files when it ends."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Paths written within each open scratch block, from outer to inner; threads do not share it.
_scratch: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: later jobs neither repeat the
    work nor depend on the executors that did it. Nothing reads the shuffle files of the
    write once it has ended, so they are given up then."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if open_ := _scratch.get():
        open_[-1].append(path)
    with shuffles_given_up(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(spark: SparkSession, *names: str) -> None:
    """Delete tables of these names that the innermost scratch block has staged so far."""
    mine = _scratch.get()[-1]
    for path in [p for p in mine if p.rpartition("/")[2].rpartition("-")[0] in names]:
        mine.remove(path)
        delete(spark, path)


@contextmanager
def scratch(spark: SparkSession):
    """Tables staged within this block are deleted at its end. It gives a function that
    stages a result, which stays until the block around this one ends, if there is one.
    Blocks of several threads do not see each other."""
    outer, mine = _scratch.get(), []
    _scratch.set((*outer, mine))

    def keep(df: DataFrame, name: str) -> DataFrame:
        inner = _scratch.get()
        _scratch.set(outer)
        try:
            return stage(df, name)
        finally:
            _scratch.set(inner)

    try:
        yield keep
    finally:
        _scratch.set(outer)
        for path in mine:
            delete(spark, path)


def held_out(doc_id, mod: int, rest: int):
    """True where crc32 of the doc_id as text leaves ``rest`` on division by ``mod``;
    a null doc_id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(True))
