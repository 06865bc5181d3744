"""Price uploads as a file stream: every new CSV dropped into a folder is validated and
upserted into the price table, one micro-batch at a time.

This is the app's import (read -> required columns -> validate -> upsert + reject report)
run incrementally.  The source is a file stream (exactly-once with the checkpoint); each
micro-batch is validated with ``validate_prices`` and merged with ``upsert_prices`` in
``foreachBatch``.

The table is kept by month: ``data/<write>/month=<yyyy-MM>``.  A batch reads and rewrites only the
months that it has rows for, as a new write, and then appends one row per rewritten month to a
small log; a reader takes the newest write of each month.  So a failed batch never exposes a
half-written table, a replayed batch leaves the table as it is, a restarted query resumes from its
checkpoint, and the work of a batch follows its months and not the table.  Writes that were replaced
before the last batch are removed; what the last batch replaced stays for readers that opened it.
Inserted rows get the next ids; the log carries the greatest id, so no batch scans the table for it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators.quality import upsert_prices, validate_prices
from ..schemas import PRICE_COLUMNS, PRICES, PRICES_CSV_TEXT
from ..session import remove, shuffles_dropped, stored_removed

LOG = "version long, month string, folder string, last_id long"
MONTH = "month"


def _versions_path(table_dir: str) -> str:
    return f"{table_dir.rstrip('/')}/_versions"


def _month_path(table_dir: str, folder: str, month: str) -> str:
    return f"{table_dir.rstrip('/')}/data/{folder}/{MONTH}={month}"


def _log(spark: SparkSession, table_dir: str) -> DataFrame | None:
    try:
        return spark.read.schema(LOG).parquet(_versions_path(table_dir))
    except AnalysisException:
        return None


def _newest(spark: SparkSession, table_dir: str) -> tuple[int, int, dict[str, str]]:
    """(version, greatest id, month -> folder of its newest write); one log row per month reaches the driver."""
    log = _log(spark, table_dir)
    if log is None:
        return -1, 0, {}
    rows = log.groupBy("month").agg(F.max(F.struct("version", "folder")).alias("v"), F.max("last_id").alias("last_id")).collect()
    return (max((r["v"]["version"] for r in rows), default=-1), max((r["last_id"] for r in rows), default=0),
            {r["month"]: r["v"]["folder"] for r in rows})


def _read_months(spark: SparkSession, table_dir: str, folders: dict[str, str]) -> DataFrame:
    paths = [_month_path(table_dir, f, m) for m, f in sorted(folders.items())]
    return spark.read.schema(PRICES).parquet(*paths) if paths else spark.createDataFrame([], PRICES)


def read_table(spark: SparkSession, table_dir: str) -> DataFrame | None:
    """All months as of the newest version (id and price columns); None before the first batch."""
    version, _, folders = _newest(spark, table_dir)
    return _read_months(spark, table_dir, folders) if version >= 0 else None


def _remove_replaced(spark: SparkSession, table_dir: str, version: int, months: list[str]) -> None:
    """Delete the writes of ``months`` that a version before ``version`` already replaced (a few a month: earlier
    batches removed theirs)."""
    w = Window.partitionBy("month").orderBy(F.desc("version"), F.desc("folder"))
    old = (_log(spark, table_dir).filter((F.col("version") < version) & F.col("month").isin(months))
           .withColumn("n", F.row_number().over(w)).filter(F.col("n").between(2, 4)).collect()) if months else []
    for r in old:
        remove(spark, _month_path(table_dir, r["folder"], r["month"]))


def start_price_ingest(spark: SparkSession, upload_dir: str, table_dir: str, rejects_dir: str, checkpoint_dir: str,
                       keys=("market", "date"), trigger: dict | None = None):
    """Start the ingest query; returns the ``StreamingQuery``."""
    if "date" not in keys:
        raise ValueError("the keys must hold the date, which names the month of a row")
    # A file stream needs a schema, and a schema is applied by position; enforceSchema=false makes
    # the reader check each header against it, so a file whose columns are out of the template
    # order fails the batch instead of being silently misread.
    src = (spark.readStream.option("header", True).option("enforceSchema", False).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_corrupt").schema(PRICES_CSV_TEXT).csv(upload_dir)
           .withColumn("_uploaded", F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start"))
           .withColumn("source_file", F.col("_metadata.file_path")))

    def merge(batch: DataFrame, batch_id: int) -> None:
        # a batch leaves its rejects, its months and a row of the log: shuffle files go with each step, its tables at the end
        with shuffles_dropped(spark), stored_removed(spark):
            merge_rows(batch, batch_id)

    def merge_rows(batch: DataFrame, batch_id: int) -> None:
        # the latest upload decides which duplicate key wins: file time, file name, place in the file
        order = F.struct("_uploaded", F.monotonically_increasing_id().alias("row"))
        # the typed rows are written once for the steps below, outside of executor memory, and removed after the upsert
        staged, whole = (f"{table_dir.rstrip('/')}/_staged/{uuid.uuid4().hex}" for _ in range(2))
        validate_prices(batch.withColumn("file_row", order).drop("_uploaded")).write.parquet(staged)
        v = spark.read.parquet(staged)
        try:
            # per-batch folders written with overwrite: a retried batch replaces its own output
            v.filter(F.col("reject_reason").isNotNull()).drop("file_row").withColumn("batch_id", F.lit(batch_id)) \
                .write.mode("overwrite").parquet(f"{rejects_dir.rstrip('/')}/batch={batch_id}")
            good = v.filter(F.col("reject_reason").isNull()).select(*PRICE_COLUMNS, "file_row")
            month = F.date_format("date", "yyyy-MM").alias(MONTH)
            touched = [r[0] for r in good.select(month).distinct().collect()]  # bounded by the calendar
            # Versions count on from the log: a replayed batch merges its rows again into the version that holds
            # them, which changes nothing, and a fresh checkpoint continues.
            version, last_id, folders = _newest(spark, table_dir)
            current = _read_months(spark, table_dir, {m: folders[m] for m in touched if m in folders})
            merged = upsert_prices(current, good, keys, last_id=last_id).select(*current.columns, month)
            # the files of the upsert's joins and numbering go before the rows are dealt by month
            merged.write.parquet(whole)
            merged = spark.read.schema(merged.schema).parquet(whole)
            remove(spark, staged)
            folder = uuid.uuid4().hex
            data = f"{table_dir.rstrip('/')}/data/{folder}"
            # rebalance: few files a month, and a large month is split over tasks
            merged.hint("rebalance", F.col(MONTH)).write.partitionBy(MONTH).parquet(data)
            if touched:
                last_id = max(last_id, spark.read.schema(PRICES).parquet(data).agg(F.max("id")).first()[0])
            # commit: the months become visible only after their data is complete, all in one file of the log
            log = [(version + 1, m, folder, last_id) for m in touched]
            spark.createDataFrame(log, LOG).coalesce(1).write.mode("append").parquet(_versions_path(table_dir))
            _remove_replaced(spark, table_dir, version + 1, touched)
        finally:
            remove(spark, staged)
            remove(spark, whole)

    w = src.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()
