"""Row-count windows for series too long for one task (hot keys).

``series.py`` computes lags and rolling means with ``Window.partitionBy(key)``: one task
holds a whole series.  That is right for daily prices (a series is bounded by the calendar)
but not when one key holds a large share of all rows.  Here the *same* window expressions run
on pieces of a series:

1. ``series_positions``: rows are range-partitioned and sorted by (key, order) — Spark's
   range partitioner splits a hot key across many partitions — and written once, so the
   layout is fixed even if executors are lost.  Each (key, partition) piece gets its first
   row id and size; a window over the *pieces* of a key (at most one per partition) turns
   them into offsets, and every row gets its exact 0-based position ``_i`` in its series.
2. ``in_blocks``: series of up to ``BLOCK`` rows fit into one window and stay as they are; only the rows of
   longer ones (counted first, by partial sums) get positions, which are cut into blocks of ``BLOCK``
   rows, and each block also gets a copy of the ``back`` rows before it.  Windows partitioned by (key, block) then see all
   the rows they look back on, so every feature of the row-count kind — lags, rolling means and
   deviations, percent changes, of any values including nulls and NaN — equals the window
   over the whole series.  One shuffle serves all features together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from . import series as S
from .series import KEYS, PRICE, _keys

POS, PIECE = "_i", "_block"
#: Rows of a series that one window holds (besides its border).
BLOCK = 1 << 16


def series_positions(df: DataFrame, keys=KEYS, order=("date", "id"), partitions: int | None = None) -> DataFrame:
    """``df`` plus ``_i`` (0-based row position within its series)."""
    ks = _keys(keys)
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = (df.repartitionByRange(n, *ks, *order).sortWithinPartitions(*ks, *order)
            .withColumns({"_pid": F.spark_partition_id(), "_mid": F.monotonically_increasing_id()}))
    # the range bounds come from sampling: fix the layout once so every later use agrees
    laid = stored(laid, "positions")
    pieces = laid.groupBy(*ks, "_pid").agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*ks).orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    out = _join_rows(laid, pieces, [*ks, "_pid"])
    return out.withColumn(POS, F.col("_off") + F.col("_mid") - F.col("_first")).drop("_pid", "_mid", "_first", "_off")


def _join_rows(df: DataFrame, more: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Join on keys that may be null."""
    other = more.withColumnsRenamed({c: f"__{c}" for c in keys})
    return df.join(other, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys], how).drop(*[f"__{c}" for c in keys])


def in_blocks(df: DataFrame, back: int, build: Callable[[DataFrame, list[str]], DataFrame], keys=KEYS,
              order=("date", "id"), partitions: int | None = None, block: int | None = None) -> DataFrame:
    """``build(rows, keys)`` over every series without a task that holds a whole one.

    ``build`` adds columns by windows partitioned by the keys it is given and ordered by ``order``,
    looking at most ``back`` rows back and none ahead; it must keep all rows and columns.
    """
    ks = _keys(keys)
    size = max(block or BLOCK, back, 1)
    # few: a long series has more than ``size`` rows
    long = stored(df.groupBy(*ks).agg(F.count(F.lit(1)).alias("_cnt")).filter(F.col("_cnt") > size).select(*ks), "long_series")
    if long.isEmpty():
        return build(df, ks)
    short = build(_join_rows(df, long, ks, "left_anti"), ks)
    own = F.floor(F.col(POS) / size)
    nearly = F.col(POS) >= (own + 1) * size - back  # the next block looks back on this row
    laid = series_positions(_join_rows(df, long, ks, "left_semi"), ks, order, partitions)
    copies = laid.withColumn(PIECE, F.explode(F.when(nearly, F.array(own, own + 1)).otherwise(F.array(own))))
    return short.unionByName(build(copies, [*ks, PIECE]).filter(F.col(PIECE) == own).drop(PIECE, POS))


def lag_split(df: DataFrame, lags=(1, 7), price_col: str = PRICE, keys=KEYS, prefix: str = "price_lag_",
              partitions: int | None = None, block: int | None = None) -> DataFrame:
    """Same result as ``series.lag_features`` with no task holding a whole series."""
    return in_blocks(df, max(lags), lambda d, k: S.lag_features(d, lags, price_col, k, prefix), keys, partitions=partitions, block=block)


def rolling_mean_split(df: DataFrame, n: int, price_col: str = PRICE, keys=KEYS, name: str | None = None,
                       full: bool = False, partitions: int | None = None, block: int | None = None) -> DataFrame:
    """Same result as ``series.rolling_mean_partial`` (``full=False``) or
    ``rolling_mean_full`` (``full=True``): exact mean of the current and n-1 previous rows."""
    rolling = S.rolling_mean_full if full else S.rolling_mean_partial
    return in_blocks(df, n - 1, lambda d, k: rolling(d, n, price_col, k, name), keys, partitions=partitions, block=block)


def pct_change_split(df: DataFrame, n: int, price_col: str = PRICE, keys=KEYS, name: str | None = None,
                     partitions: int | None = None, block: int | None = None) -> DataFrame:
    """Same result as ``series.pct_change``."""
    return in_blocks(df, n, lambda d, k: S.pct_change(d, n, price_col, k, name), keys, partitions=partitions, block=block)


def chrono_split_split(df: DataFrame, frac: float = 0.8, keys=KEYS, name: str = "is_train",
                       partitions: int | None = None) -> DataFrame:
    """Same result as ``series.chrono_split``: the first floor(frac * rows) rows of every
    series train; the row count is a partial aggregate, the position comes from
    ``series_positions``."""
    ks = _keys(keys)
    pos = series_positions(df, ks, partitions=partitions)
    counts = df.groupBy(*ks).agg(F.count(F.lit(1)).alias("_cnt"))
    return _join_rows(pos, counts, ks).withColumn(name, F.col(POS) < F.floor(F.col("_cnt") * F.lit(frac))).drop(POS, "_cnt")
