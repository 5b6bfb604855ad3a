"""Session helpers shared by every operator."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A small session for tests and benchmarks; production jobs bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor can reach.

    It is the cluster's ``spark.checkpoint.dir``; only where that is unset and the master is
    ``local`` (tests, a single machine) a temporary folder is created and set. On a cluster
    such a folder would be another one on every machine, so that is an error.
    """
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not told and jvm_dir.isDefined():
        told = jvm_dir.get()
    if not told:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        told = "file://" + tempfile.mkdtemp(prefix="lattica-")
    if not jvm_dir.isDefined():
        spark.sparkContext.setCheckpointDir(told)
    return told.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for a written intermediate table, unique to this call."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


#: Has Spark delete an execution's shuffle files at its end; else they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what is run inside go as each run ends."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


#: Scratch tables of the open scopes, the innermost last.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def write_and_reread(df: DataFrame, name: str, row_group_mb: int = 32) -> DataFrame:
    """Cut the lineage: write to the shared folder as Parquet and read it again.

    Row groups are small, as each writing task holds one in memory. What the write shuffled goes with it. Within a ``scratched``
    function the table goes when the function is done, unless it is what it returns.
    """
    path = scratch_path(df.sparkSession, name)
    if _SCOPES.get():
        _SCOPES.get()[-1].append(path)
    with shuffles_freed(df.sparkSession):
        df.write.option("parquet.block.size", row_group_mb << 20).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def scratched(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Deletes the scratch tables that the function's run wrote, once its result is written.

    The result stays, as a table of the scope outside if there is one: the caller reads it
    lazily. A run that fails deletes its tables too.
    """

    @functools.wraps(function)
    def run(*args, **options) -> DataFrame:
        outer, own = _SCOPES.get(), []
        token = _SCOPES.set((*outer, own))
        spark, kept = None, None
        try:
            out = function(*args, **options)
            spark = out.sparkSession
            if getattr(out, "scratch_path", None) not in own:
                out = write_and_reread(out, function.__name__.replace("_", "-"))
            kept = out.scratch_path
            return out
        finally:
            _SCOPES.reset(token)
            spark = spark or SparkSession.getActiveSession()
            for path in own:
                if path != kept and spark:
                    remove_path(spark, path)
            if kept and outer:
                outer[-1].append(kept)

    return run


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more, before their scope ends."""
    for table in tables:
        remove_path(table.sparkSession, table.scratch_path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
