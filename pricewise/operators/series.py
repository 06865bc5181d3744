"""Per-series window operators (section 2.7).

A *series* is the rows of one key (default ``market``) ordered by ``(date, id)``; ``id``
breaks ties so every ordered result is deterministic.  Lags and windows count **rows**,
not calendar days, as the app does (``*_7`` = 7 rows).

Scale notes
* All windows share one spec per key set, so Spark plans one shuffle + one sort per series
  key and reuses it for every feature column.
* "Last k rows" filters on ``row_number() <= k`` over a descending spec; Spark turns this
  into a WindowGroupLimit that keeps only k rows per key *before* the shuffle, so even a
  market holding a third of all rows ships k rows per map task.
* Never a window without ``partitionBy`` over raw rows: the pooled variant first
  pre-aggregates to one row per date (bounded by the calendar), see ``pooled_daily``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

PRICE = "modal_price"
KEYS = ("market",)

# Sums of prices do not depend on the order in which rows meet.  A price is split without rounding into four whole
# numbers - its parts from 2**31 up, from 1 up, from 2**-26 up and from 2**-52 up (what is finer, in prices under 1, is
# cut off) - each of which is summed as a long.  A mean is then one fixed chain of operations on these four sums, so
# it is the same full double on any partitioning, after any retry.
_UP, _DOWN = float(1 << 31), float(1 << 26)


def usable(c) -> Column:
    """The price; null for one that is null, NaN or infinite (or beyond 2**62): no mean counts such a row."""
    cc = F.col(c) if isinstance(c, str) else c
    return F.when(F.abs(cc) < F.lit(float(1 << 62)), cc)


def price_sum(c, over: WindowSpec | None = None) -> Column:
    """Exact sum of prices as a struct of whole sums (an aggregate, or a window function with ``over``); see ``exact_mean``."""
    x = usable(c).cast("double")
    top, whole = F.floor(x / _UP), F.floor(x)
    rest = (x - whole) * _DOWN
    fine = F.floor(rest)
    parts = {"top": top, "whole": whole - top * F.lit(1 << 31), "part": fine, "fine": F.floor((rest - fine) * _DOWN)}
    sums = {k: F.sum(v) if over is None else F.sum(v).over(over) for k, v in parts.items()}
    return F.struct(*[v.alias(k) for k, v in sums.items()])


def exact_mean(sum_col: str, n_col: str) -> Column:
    """The mean from a ``price_sum`` and a count of usable prices; null when the count is 0."""
    s = lambda k: F.col(f"{sum_col}.{k}").cast("double")
    total = (s("top") * _UP + s("whole")) + (s("part") + s("fine") / _DOWN) / _DOWN
    return F.when(F.col(n_col) > 0, total / F.col(n_col))


def window_means(df: DataFrame, frames: dict[str, tuple[int, int]], price_col: str, w: WindowSpec, full: bool = False) -> DataFrame:
    """Add for every name the exact mean of ``price_col`` over its rows from ``start`` to ``end`` (not after the current
    one) of the ordered window ``w`` (null unless all of them are usable, with ``full``).

    Whole sums are exact, so a frame's sum is a difference of two running sums: a row costs the same for any length."""
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumns({"__s": price_sum(price_col, so_far), "__n": F.count(usable(price_col)).over(so_far)})
    at = lambda c, k: F.lag(c, k).over(w) if k else F.col(c)
    behind = sorted({k for start, end in frames.values() for k in (-end, 1 - start)})
    out = out.withColumns({f"__{c}{k}": at(f"__{c}", k) for k in behind for c in "sn"})
    for name, (start, end) in frames.items():
        upto, before = -end, 1 - start
        parts = [(F.coalesce(F.col(f"__s{upto}.{p}"), F.lit(0)) - F.coalesce(F.col(f"__s{before}.{p}"), F.lit(0))).alias(p)
                 for p in ("top", "whole", "part", "fine")]
        n = F.coalesce(f"__n{upto}", F.lit(0)) - F.coalesce(f"__n{before}", F.lit(0))
        out = out.withColumns({"__sum": F.struct(*parts), "__cnt": n})
        m = exact_mean("__sum", "__cnt")
        out = out.withColumn(name, F.when(F.col("__cnt") == end - start + 1, m) if full else m)
    return out.drop("__s", "__n", "__sum", "__cnt", *[f"__{c}{k}" for k in behind for c in "sn"])


def _keys(keys) -> list[str]:
    if keys is None:
        return list(KEYS)
    if isinstance(keys, str):
        return [keys]
    return list(keys)


def series_window(keys=KEYS, order=("date", "id")) -> WindowSpec:
    return Window.partitionBy(*_keys(keys)).orderBy(*[F.col(c) for c in order])


def series_window_desc(keys=KEYS, order=("date", "id")) -> WindowSpec:
    return Window.partitionBy(*_keys(keys)).orderBy(*[F.col(c).desc() for c in order])


def default_as_of(df: DataFrame, date_col: str = "date") -> Column:
    """max(date) of the table as a scalar subquery (evaluated once, no driver collect)."""
    return df.agg(F.max(date_col)).scalar()


def as_of_column(df: DataFrame, as_of=None, date_col: str = "date") -> Column:
    if as_of is None:
        return default_as_of(df, date_col)
    if isinstance(as_of, Column):
        return as_of
    return F.lit(as_of).cast("date")


def pooled_daily(prices: DataFrame, price_col: str = PRICE) -> DataFrame:
    """All markets pooled into one series: one row per date (mean price), id = day number.

    The pooled series length is bounded by the number of calendar days, so a single
    un-keyed window over it is safe.
    """
    return (prices.groupBy("date")
            .agg(price_sum(price_col).alias("__s"), F.count(usable(price_col)).alias("__n"),
                 F.min("min_price").alias("min_price"),
                 F.max("max_price").alias("max_price"),
                 F.sum("arrival_quantity").alias("arrival_quantity"))
            .withColumn(price_col, exact_mean("__s", "__n")).drop("__s", "__n")
            .withColumn("id", F.unix_date("date").cast("long"))
            .withColumn("market", F.lit("ALL")))


def load_recent_window(prices: DataFrame, as_of=None, days: int = 730, columns=None) -> DataFrame:
    """Rows dated within ``days`` before ``as_of`` (inclusive)."""
    a = as_of_column(prices, as_of)
    out = prices.filter((F.col("date") >= F.date_sub(a, days)) & (F.col("date") <= a))
    if columns:
        out = out.select(*columns)
    return out


def lag_features(df: DataFrame, lags=(1, 7), price_col: str = PRICE, keys=KEYS, prefix="price_lag_") -> DataFrame:
    w = series_window(keys)
    return df.withColumns({f"{prefix}{n}": F.lag(price_col, n).over(w) for n in lags})


def rolling_mean_partial(df: DataFrame, n: int, price_col: str = PRICE, keys=KEYS, name=None) -> DataFrame:
    """Mean of the current and up to n-1 previous rows (min_periods=1)."""
    return window_means(df, {name or f"price_ma_{n}": (1 - n, 0)}, price_col, series_window(keys))


def rolling_mean_full(df: DataFrame, n: int, price_col: str = PRICE, keys=KEYS, name=None) -> DataFrame:
    """Mean of exactly n rows; null until the series has n rows."""
    return window_means(df, {name or f"price_rolling_mean_{n}": (1 - n, 0)}, price_col, series_window(keys), full=True)


def rolling_std_full(df: DataFrame, n: int, price_col: str = PRICE, keys=KEYS, name=None) -> DataFrame:
    """Sample standard deviation of exactly n rows; null until n rows."""
    w = series_window(keys).rowsBetween(-(n - 1), 0)
    return df.withColumn(name or f"price_rolling_std_{n}",
                         F.when(F.count(price_col).over(w) == n, F.stddev_samp(price_col).over(w)))


def pct_change(df: DataFrame, n: int, price_col: str = PRICE, keys=KEYS, name=None) -> DataFrame:
    """(x - x[n rows back]) / x[n rows back]; null when undefined (pandas gives inf on 0)."""
    prev = F.lag(price_col, n).over(series_window(keys))
    return df.withColumn(name or f"price_change_{n}", F.try_divide(F.col(price_col) - prev, prev))


def with_row_numbers(df: DataFrame, keys=KEYS, name: str = "_rn", desc: bool = True) -> DataFrame:
    w = series_window_desc(keys) if desc else series_window(keys)
    return df.withColumn(name, F.row_number().over(w))


def last_n_rows(df: DataFrame, n: int, keys=KEYS) -> DataFrame:
    """The newest n rows of every series (WindowGroupLimit-friendly)."""
    return with_row_numbers(df, keys).filter(F.col("_rn") <= n).drop("_rn")


def tail(df: DataFrame, k: int, keys=KEYS, price_col: str = PRICE, extra=()) -> DataFrame:
    """Newest k rows per series with ``_rn`` (1 = newest); only the needed columns travel."""
    cols = list(dict.fromkeys([*_keys(keys), "date", "id", price_col, *extra]))
    return with_row_numbers(df.select(*cols), keys).filter(F.col("_rn") <= k)


def tail_stats(df: DataFrame, n: int = 7, keys=KEYS, price_col: str = PRICE) -> DataFrame:
    """min / max / avg / count over the last n rows of every series."""
    t = tail(df, n, keys, price_col)
    return (t.groupBy(*_keys(keys))
            .agg(F.min(price_col).alias(f"min_{n}"), F.max(price_col).alias(f"max_{n}"),
                 price_sum(price_col).alias("__s"), F.count(usable(price_col)).alias("__n"),
                 F.count(F.lit(1)).alias(f"rows_{n}"))
            .withColumn(f"avg_{n}", exact_mean("__s", "__n")).drop("__s", "__n"))


def nth_last(rn: str, k: int, price_col: str = PRICE) -> Column:
    return F.max(F.when(F.col(rn) == k, F.col(price_col)))


def nth_last_change(df: DataFrame, k: int, keys=KEYS, price_col: str = PRICE, pct: bool = True) -> DataFrame:
    """Change of the newest price against the k-th newest (k=2: previous row)."""
    t = tail(df, k, keys, price_col)
    g = (t.groupBy(*_keys(keys))
         .agg(nth_last("_rn", 1, price_col).alias("last_price"),
              nth_last("_rn", k, price_col).alias(f"price_{k}_back")))
    ch = F.try_divide(F.col("last_price") - F.col(f"price_{k}_back"), F.col(f"price_{k}_back"))
    return g.withColumn(f"change_vs_{k}", ch * 100 if pct else ch)


def filter_min_history(df: DataFrame, n: int = 7, keys=KEYS) -> DataFrame:
    """Keep series with at least n rows (count per key is a partial aggregate, then semi join)."""
    ok = df.groupBy(*_keys(keys)).count().filter(F.col("count") >= n).drop("count")
    return df.join(ok, _keys(keys), "left_semi")


# History guards before forecasting (rows overall / per market).
MIN_TOTAL_ROWS = 30
LIMITED_MARKET_ROWS = 15
MIN_SERIES_ROWS = 7


def history_guards(prices: DataFrame, keys=KEYS) -> DataFrame:
    """Per series: row count and status — 'insufficient' (< 7 rows, no forecast), 'limited'
    (< 15, forecast with a warning) or 'ok' — plus the table total and whether it reaches the
    30-row minimum for forecasting at all.  Two partial aggregates, no driver count."""
    ks = _keys(keys)
    total = prices.agg(F.count(F.lit(1))).scalar()
    n = F.col("rows")
    status = (F.when(n < MIN_SERIES_ROWS, "insufficient").when(n < LIMITED_MARKET_ROWS, "limited").otherwise("ok"))
    return (prices.groupBy(*ks).agg(F.count(F.lit(1)).alias("rows"))
            .select(*ks, "rows", status.alias("status"), total.alias("total_rows"),
                    (total >= MIN_TOTAL_ROWS).alias("enough_total")))


def chrono_split(df: DataFrame, frac: float = 0.8, keys=KEYS, name: str = "is_train") -> DataFrame:
    """Per series: the first floor(frac * rows) rows by time are training rows."""
    ks = _keys(keys)
    w = series_window(ks)
    n = F.count(F.lit(1)).over(Window.partitionBy(*ks))
    return df.withColumn(name, F.row_number().over(w) <= F.floor(n * F.lit(frac)))


def chrono_split_pooled(df: DataFrame, frac: float = 0.8, name: str = "is_train") -> DataFrame:
    """Pooled split without an un-keyed window: rows before the cut date train.

    The cut is the first date whose cumulative row count reaches floor(frac * n); the
    per-date counts are one row per day, so the running sum is over a calendar-bounded set.
    """
    per_day = df.groupBy("date").count()
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    total = df.count()
    target = int(total * frac)
    cum = per_day.withColumn("_cum", F.sum("count").over(w))
    cut = cum.filter(F.col("_cum") >= target).agg(F.min("date")).scalar()
    return df.withColumn(name, F.col("date") < cut)


def naive_baseline(df: DataFrame, keys=KEYS, price_col: str = PRICE) -> DataFrame:
    """Tomorrow = today: the previous row's price is the prediction."""
    return df.withColumn("prediction", F.lag(price_col, 1).over(series_window(keys)))
