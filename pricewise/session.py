"""Session construction and the shared working folder.

The cluster names a shared, fault-tolerant folder in ``spark.checkpoint.dir``; every
materialised table, checkpoint and sink in this library lives under it.  Only when the
setting is absent (local tests) do we set one ourselves.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Settings every job wants: AQE re-plans joins/partition counts from runtime sizes,
# skew-join splits hot keys, and Arrow speeds the few pandas hand-offs.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # reliable checkpoints (recursive forecast, hot-series layout) are removed once unreferenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, app: str = "pricewise", shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the library defaults applied."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a local one only when none is configured."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        # Tests / local runs only: on a cluster, executors could not see a folder of the driver's machine.
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="pricewise-ckpt-", dir=os.environ.get("PRICEWISE_LOCAL_DIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """What is written or collected inside takes its shuffle files along when it ends.  Else they stay until the driver
    happens to collect its garbage, which one with much memory seldom does: a job of many steps then holds the files of
    all of them.  Only for frames that run once (a second run of the same frame would make the files anew)."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


_STORED: ContextVar[list | None] = ContextVar("stored", default=None)


@contextmanager
def stored_removed(spark: SparkSession):
    """Tables that ``stored`` writes inside go at the end, by when what reads them must be written."""
    token = _STORED.set([])
    try:
        yield
    finally:
        made = _STORED.get()
        _STORED.reset(token)
        for path in made:
            remove(spark, path)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path):
        fs.delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet under the shared folder and read back: what several jobs read is computed
    once, and a lost executor costs a read."""
    path = shared_path(df.sparkSession, "stored", name, unique=True)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    if _STORED.get() is not None:
        _STORED.get().append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_path(spark: SparkSession, *parts: str, unique: bool = False) -> str:
    """A path under the shared folder; ``unique`` appends a fresh id (one per write)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    tail = "/".join(p.strip("/") for p in parts if p)
    if unique:
        tail = f"{tail}/{uuid.uuid4().hex}" if tail else uuid.uuid4().hex
    return f"{base}/{tail}" if tail else base
