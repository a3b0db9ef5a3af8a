"""Session construction and materialisation helpers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Settings every job in the library relies on: UTC wall clock (fixture timestamps are naive),
# adaptive execution for runtime re-planning, skew splitting and partition coalescing.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None, app_name: str = "shiftlens",
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library defaults.

    ``master`` and ``shuffle_partitions`` are only meant for local runs; on a cluster leave them
    unset and let the submit configuration decide.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if master and master.startswith("local"):
        conf["spark.driver.memory"] = "8g"  # local runs: the driver JVM is the only executor
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession, default: str | None = None) -> str | None:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    The setting comes from the session (on a cluster: a file system that the driver and all executors
    share). ``default`` is used only where it is unset, as in tests. A session on one machine
    (master ``local...``) without either gets a fresh folder; anywhere else the result is None.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or default
    if not path and sc.getCheckpointDir() is None and sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        import tempfile
        path = tempfile.mkdtemp(prefix="shiftlens-ckpt-")
    if path and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for a table in the shared checkpoint folder; an error where none is set."""
    folder = checkpoint_dir(spark)
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Bytes of the Arrow batches that go to Python inside ``lean``.
BATCH_BYTES = 8 << 20
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: With it, Spark deletes a query's shuffle files when the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """For DataFrames that are made and computed inside, each once.

    Arrow batches have about ``BATCH_BYTES`` instead of 64 MB: of wide rows a task holds one batch in the JVM, which grows by
    doubling, and one in Python. No shuffle files stay: nothing reads them again once the result is there."""
    wanted = {CLEANUP: "true"}
    if not 0 < spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() <= BATCH_BYTES:
        wanted[BATCH] = str(BATCH_BYTES)
    before = {k: spark.conf.get(k, None) for k in wanted}  # None where the session does not set it
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def release() -> None:
    """Give freed memory back to the system at the end of a task: workers are used again, and what each keeps adds up over stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def materialize(df: DataFrame, how: str = "persist") -> DataFrame:
    """Make a reused intermediate result cheap to read again.

    ``persist``    - memory and disk; lost blocks are recomputed from lineage.
    ``checkpoint`` - reliable checkpoint in ``spark.checkpoint.dir`` (cuts lineage; survives lost
                     executors); an error where no shared folder is set.
    ``none``       - leave the plan as it is.
    """
    if how == "persist":
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    if how == "checkpoint":
        if checkpoint_dir(df.sparkSession) is None:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        return df.checkpoint(eager=True)
    if how == "none":
        return df
    raise ValueError(f"unknown materialisation {how!r}")
