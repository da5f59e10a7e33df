"""Session settings and the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import ExitStack, contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; ``conf`` wins over the defaults."""
    builder = SparkSession.builder.appName("threadloom")
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which every executor can read.

    Where a session on one machine names none (tests), a fresh local folder is made and set as its checkpoint
    folder, so that ``DataFrame.checkpoint`` and written tables go to the same place. On a cluster a folder of
    the driver's machine would be lost to the executors, so there a missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        context = spark.sparkContext
        named = context.getCheckpointDir()
        if not named:
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="spark-shared-")
            context.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_dir(spark)}/threadloom/{what}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts the lineage and survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_table(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back, for results that several plans use."""
    spark = df.sparkSession
    path = scratch_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that is run inside go when it ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, held)


def put_table(df: DataFrame, what: str) -> DataFrame:
    """``write_table`` in little space: closer compression, and no shuffle file of ``df`` is left."""
    return _put(df, scratch_path(df.sparkSession, what))


def _put(df: DataFrame, path: str, mode: str = "error", folder: str | None = None) -> DataFrame:
    writer = df.write.mode(mode).option("compression", "zstd")
    with shuffles_dropped(df.sparkSession):
        (writer.partitionBy(folder) if folder else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def put_stepwise(steps: list, make: Callable[[object, Callable], DataFrame], spark: SparkSession, what: str) -> DataFrame:
    """``put_table`` of the rows that ``make`` gives for each of ``steps``: a step is written before the next begins, so no more
    than one has shuffles. ``make(step, aside)``: ``aside(df, what)`` puts a table aside for the time of its step."""
    path, rows = scratch_path(spark, what), None
    for step in steps:
        with ExitStack() as stack:
            rows = _put(make(step, lambda df, name, stack=stack: stack.enter_context(put_aside(df, name))), path, "append")
    return rows


@contextmanager
def put_aside(df: DataFrame, what: str, folder: str | None = None) -> Iterator[DataFrame]:
    """``put_table`` for the time of a block; nothing that is read after it may depend on the table. ``folder`` is its folder column."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, what)
    try:
        yield _put(df, path, folder=folder)
    finally:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
