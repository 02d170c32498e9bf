"""Session settings the library relies on, and the one place that cuts lineage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tablescope")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate data, set on the context.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset, a folder below the
    warehouse serves, because every executor reaches the warehouse too.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_intermediate")
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


#: Run folders that are open, innermost last.
_OPEN: ContextVar[tuple[str, ...]] = ContextVar("open run folders", default=())


def scratch_path(spark: SparkSession, name: str, outside: bool = False) -> str:
    """A fresh path below the checkpoint folder, which all executors can reach: in the run folder that is open, or ``outside`` of it."""
    folders = (checkpoint_folder(spark), *_OPEN.get())
    return f"{folders[-2] if outside and len(folders) > 1 else folders[-1]}/{name}-{uuid.uuid4().hex}"


@contextmanager
def intermediate(spark: SparkSession) -> Iterator[None]:
    """A run folder for what is written meanwhile; it is deleted at the end, with all that was not written ``outside`` of it.

    Results must be written or collected before the end. A caller of several operators may open one around them all.
    """
    folder = scratch_path(spark, "run")
    token = _OPEN.set((*_OPEN.get(), folder))
    try:
        yield
    finally:
        _OPEN.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
