"""Session settings the library relies on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType


TRAINING_ROWS = 1_000_000
_LOCAL: dict[str, str] = {}  # folders of local sessions that were given none


def build_session(app: str = "tidemill", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session may fall back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    # a setting of the core cannot be changed in a running session: the folder is remembered here
    application = spark.sparkContext.applicationId
    if application not in _LOCAL:
        _LOCAL[application] = tempfile.mkdtemp(prefix="tidemill-")
    return _LOCAL[application]


def shared_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it back, so that it is computed once
    and what is read later is what was written."""
    path = shared_path(df.sparkSession, name) if path is None else path
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def small_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """What runs inside sends batches of ``size`` bytes at most to Python, or of one row."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def spread_small(df: DataFrame) -> DataFrame:
    """A small table over all cores before it is read many times.

    A table below one file split per core may sit in a single partition (one row group);
    shuffling it once is cheap. Anything larger is already spread and left alone.
    """
    if df.isStreaming:
        return df
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if not split / 64 < size < split * cores:
        return df
    # by hash: dealing rows out in turn would first sort them, to be repeatable
    names = [f.name for f in df.schema.fields if not isinstance(f.dataType, MapType)]
    return df.repartition(max(cores, 8 * size // split), *[F.col("`" + n.replace("`", "``") + "`") for n in names])


def spread_training(df: DataFrame, rows: int) -> DataFrame:
    """``spread_small`` for rows that a learner keeps in memory and reads in every round: a task
    gets ``TRAINING_ROWS`` at most, however few files the rows lie in and however many are equal.

    The learners keep some 150 bytes for a row, far more than its numbers take in a file.
    """
    if df.isStreaming or rows <= TRAINING_ROWS:
        return spread_small(df)
    parts = max(-(-rows // TRAINING_ROWS), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(parts)  # in turn, as a hash would put equal rows into one task


def use_checkpoints(spark: SparkSession) -> None:
    """Lets long-running learners cut their lineage in the shared folder, if there is one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named or context.master.startswith("local"):
            context.setCheckpointDir(named or shared_dir(spark))
