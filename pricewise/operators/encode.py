"""Feature encoding and feature sets (survey 2.11, encoding half).

* ``one_hot``      named 0/1 columns for low-cardinality columns (pandas ``get_dummies``
                   semantics: sorted values, first level dropped).  The distinct values are
                   fetched up to ``max_values`` of them, which shows whether there are fewer.
* ``one_hot_vectors`` the same dummies for any number of values, as one sparse vector.
* ``label_encode`` 0-based rank of the sorted distinct values, computed distributed and exact
                   (``value_codes``); ``label_indexer`` is the same as a Spark ML stage.
* ``standard_scale`` fit on the training rows (mean, population std) as one row, and applied to any
                   rows by a join with it: nothing is collected.
* ``build_features_simple`` / ``build_features_full`` the two feature sets, per series.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import date_parts, season
from ..session import stored
from .series import KEYS, PRICE, _keys, last_n_rows, series_window, window_means


def few_values(df: DataFrame, cols, max_values: int = 20) -> dict[str, list]:
    """The sorted non-null values of every column with fewer than ``max_values`` of them: one pass a column, and never
    more than ``max_values`` values in the driver."""
    found = {c: [r[0] for r in df.select(c).filter(F.col(c).isNotNull()).distinct().orderBy(c).limit(max_values).collect()]
             for c in cols}
    return {c: values for c, values in found.items() if len(values) < max_values}


def low_cardinality(df: DataFrame, cols, max_values: int = 20) -> list[str]:
    return list(few_values(df, cols, max_values))


def one_hot(df: DataFrame, cols=("market", "state", "variety"), max_values: int = 20, drop_first: bool = True,
            drop_source: bool = True) -> tuple[DataFrame, list[str]]:
    """Add ``{col}_{value}`` 0/1 columns for every column with fewer than ``max_values`` values.
    Returns the frame and the dummy column names (the fitted layout for scoring)."""
    names = []
    out = df
    for c, values in few_values(df, list(cols), max_values).items():
        if drop_first:
            values = values[1:]
        for v in values:
            n = f"{c}_{v}"
            out = out.withColumn(n, (F.col(c) == F.lit(v)).cast("int"))
            names.append(n)
    if drop_source:
        out = out.drop(*[c for c in cols if c in out.columns])
    return out, names


def one_hot_align(df: DataFrame, layout: list[str], cols=("market", "state", "variety")) -> DataFrame:
    """Score-time dummies: exactly the training layout; unseen values give all zeros."""
    exprs = {}
    for n in layout:
        c = next(cc for cc in cols if n.startswith(cc + "_"))
        exprs[n] = F.coalesce((F.col(c) == F.lit(n[len(c) + 1:])).cast("int"), F.lit(0))
    return df.withColumns(exprs)


def value_codes(df: DataFrame, cols, suffix: str = "_code") -> dict[str, DataFrame]:
    """{column: (value, code)} with code = 0-based rank of the value (as text, like pandas'
    ``LabelEncoder`` over ``astype(str)``) among the column's sorted distinct non-null values.

    Distributed and exact in one pass for all columns: the distinct (column, value) pairs are
    stacked and given their position within their column by ``long_series.series_positions``
    (range layout + one checkpoint + per-partition offsets).  No task or driver holds all values.
    """
    from .long_series import POS, series_positions
    cols = list(cols)
    pairs = (df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("_col"), F.col(c).cast("string").alias("_v"))
                                           for c in cols])).alias("_x"))
             .select("_x.*").filter(F.col("_v").isNotNull()).distinct())
    pos = series_positions(pairs, keys=["_col"], order=["_v"])
    return {c: pos.filter(F.col("_col") == c).select(F.col("_v").alias(f"_{c}_text"),
                                                     F.col(POS).cast("int").alias(f"{c}{suffix}"))
            for c in cols}


def join_codes(df: DataFrame, codes: dict[str, DataFrame]) -> DataFrame:
    """``df`` with the codes of ``value_codes``; a null value, or one that the codes do not know, has a null code."""
    for c, table in codes.items():
        t = f"_{c}_text"
        df = df.withColumn(t, F.col(c).cast("string")).join(table, t, "left").drop(t)
    return df


def label_encode(df: DataFrame, cols=("market", "state", "district", "variety"), suffix: str = "_code"):
    """Add ``{col}{suffix}`` = index of the value (as text, in byte order) among the column's sorted distinct
    values, for every column (``value_codes``: distributed, nothing held by the driver at any size).
    Returns (frame, {column: codes frame})."""
    codes = value_codes(df, list(cols), suffix)
    return join_codes(df, codes), codes


@dataclass
class Dummies:
    """A fitted one-hot layout: codes per column, their number, and the ML stages."""

    codes: dict[str, DataFrame]
    sizes: dict[str, int]
    stages: PipelineModel


def one_hot_fit(df: DataFrame, cols=("market", "state", "variety"), out: str = "dummies") -> Dummies:
    """Fit a sparse one-hot layout of any number of values (first level dropped, as in ``get_dummies(drop_first=True)``).

    Values are numbered by ``value_codes``, so neither a column per value nor a list of values exists;
    the driver knows only how many values a column has."""
    codes = value_codes(df, list(cols), "_slot")
    sizes = {c: t.count() for c, t in codes.items()}
    some = [c for c in cols if sizes[c] > 1]  # one value is the dropped level
    coded = _slots(df, codes, sizes)
    encoder = OneHotEncoder(inputCols=[f"{c}_slot" for c in some], outputCols=[f"_{c}_vector" for c in some], dropLast=True)
    stages = [encoder, VectorAssembler(inputCols=[f"_{c}_vector" for c in some], outputCol=out)] if some else []
    return Dummies(codes, sizes, Pipeline(stages=stages).fit(coded))


def _slots(df: DataFrame, codes: dict[str, DataFrame], sizes: dict[str, int]) -> DataFrame:
    """Codes turned so that the first value is last, the slot that the encoder drops; a null or unknown value also goes there."""
    out = join_codes(df, codes)
    return out.withColumns({f"{c}_slot": F.when(F.col(f"{c}_slot") > 0, F.col(f"{c}_slot") - 1).otherwise(F.lit(n - 1)) for c, n in sizes.items()})


def one_hot_vectors(df: DataFrame, fitted: Dummies) -> DataFrame:
    """``df`` with one sparse vector of the dummies of all columns, in the order of columns and values; all zeros
    for values that the fit did not see."""
    out = fitted.stages.transform(_slots(df, fitted.codes, fitted.sizes))
    return out.drop(*[f"{c}_slot" for c in fitted.codes], *[f"_{c}_vector" for c in fitted.codes])


def label_indexer(cols=("market", "state", "district", "variety"), suffix: str = "_code") -> StringIndexer:
    """The same encoding as an ML stage (for Pipelines); its fit keeps the labels in the driver,
    so prefer ``label_encode`` for very high-cardinality columns."""
    cols = list(cols)
    return StringIndexer(inputCols=cols, outputCols=[f"{c}{suffix}" for c in cols], stringOrderType="alphabetAsc",
                         handleInvalid="keep")


def standard_scale(train: DataFrame, data: DataFrame, cols, suffix: str = "_scaled") -> DataFrame:
    """(x - mean) / std with mean and population std of the training rows (zero std -> 1).

    The fit is one row, joined to ``data``: the training rows are read once for all columns."""
    fit = train.agg(*[F.avg(c).alias(f"__m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"__s_{c}") for c in cols])
    out = data.crossJoin(F.broadcast(fit))  # one row
    scaled = {f"{c}{suffix}": (F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"__s_{c}")) for c in cols}
    return out.withColumns(scaled).drop(*[f"__{k}_{c}" for k in "ms" for c in cols])


SIMPLE_LAGS = (1, 7)
SIMPLE_COMPLETE = ["price_lag_1", "price_lag_7", "price_ma_7", "price_ma_30", "price_change_1", "price_change_7"]


def _simple_windows(df: DataFrame, keys, leak_free: bool, price_col: str) -> DataFrame:
    w = series_window(keys)
    end = -1 if leak_free else 0
    src = F.lag(price_col, 1).over(w) if leak_free else F.col(price_col)
    prev1, prev7 = (F.lag(price_col, k - end).over(w) for k in SIMPLE_LAGS)
    out = df.withColumns({"price_lag_1": F.lag(price_col, 1).over(w), "price_lag_7": F.lag(price_col, 7).over(w),
                          "price_change_1": F.try_divide(src - prev1, prev1), "price_change_7": F.try_divide(src - prev7, prev7)})
    return window_means(out, {"price_ma_7": (-6 + end, end), "price_ma_30": (-29 + end, end)}, price_col, w)


def build_features_simple(prices: DataFrame, keys=KEYS, leak_free: bool = False, last_rows: int | None = None,
                          price_col: str = PRICE, encode: bool = True, max_values: int = 20,
                          hot_series: bool = False):
    """Calendar parts, lags 1/7, partial means 7/30, changes 1/7, dummies; incomplete rows dropped.

    ``leak_free`` computes the means and changes from the rows *before* the current one, so no
    feature contains the target.  All rows count; ``last_rows`` takes only the newest so many of
    every series (the reference trains on the newest 365 of the whole frame).  ``hot_series``
    computes the same values without a task that holds a whole series (``long_series.in_blocks``).
    With ``encode`` the features are written once (shared folder): the search for the dummies' values and the
    caller read that table instead of computing the windows again.
    Returns (features, dummy column names).
    """
    ks = _keys(keys)
    df = last_n_rows(prices, last_rows, ks) if last_rows else prices
    if hot_series:
        from .long_series import in_blocks
        base = in_blocks(df, 30, lambda d, k: _simple_windows(d, k, leak_free, price_col), ks)
    else:
        base = _simple_windows(df, ks, leak_free, price_col)
    base = base.withColumns({"day_of_year": F.dayofyear("date"), "month": F.month("date"), "year": F.year("date")}) \
        .na.drop("any", subset=SIMPLE_COMPLETE)
    names: list[str] = []
    if encode:
        base, names = one_hot(stored(base, "features"), [c for c in ("market", "state", "variety") if c in base.columns], max_values,
                              drop_source=False)
    return base, names


FULL_LAGS = (1, 7, 30, 90)


def _full_windows(df: DataFrame, keys, leak_free: bool, price_col: str) -> DataFrame:
    w = series_window(keys)
    end = -1 if leak_free else 0
    last7 = w.rowsBetween(-6 + end, end)
    out = df.withColumns({**{f"price_lag_{n}": F.lag(price_col, n).over(w) for n in FULL_LAGS},
                          "price_rolling_std_7": F.when(F.count(price_col).over(last7) == 7, F.stddev_samp(price_col).over(last7))})
    return window_means(out, {"price_rolling_mean_7": (-6 + end, end), "price_rolling_mean_30": (-29 + end, end)}, price_col, w, full=True)


def build_features_full(prices: DataFrame, keys=KEYS, leak_free: bool = False, price_col: str = PRICE,
                        hot_series: bool = False):
    """7 calendar parts, season, lags 1/7/30/90, rolling mean 7 / std 7 / mean 30 (full windows),
    label codes of market/state/district/variety (fitted on all rows); incomplete rows dropped.  ``hot_series``
    computes the window features without a task that holds a whole series (``long_series.in_blocks``)."""
    ks = _keys(keys)
    df, model = label_encode(prices, [c for c in ("market", "state", "district", "variety") if c in prices.columns])
    df = df.withColumns(date_parts("date")).withColumn("season", season(F.col("month")))
    if hot_series:
        from .long_series import in_blocks
        df = in_blocks(df, max(FULL_LAGS), lambda d, k: _full_windows(d, k, leak_free, price_col), ks)
    else:
        df = _full_windows(df, ks, leak_free, price_col)
    df = df.na.drop("any", subset=[f"price_lag_{n}" for n in FULL_LAGS]
                    + ["price_rolling_mean_7", "price_rolling_std_7", "price_rolling_mean_30"])
    return df, model
