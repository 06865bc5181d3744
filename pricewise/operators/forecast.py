"""Forecast, trend and advice for every market in one job (section 2.12).

* ``price_trend``        last-vs-previous change class + statistics over the last rows.
* ``latest_feature_row`` the one feature row per series the predictor scores.
* ``initial_prediction`` model prediction, falling back to the mean of the last 7 rows.
* ``forecast_7d``        damped-trend path folded with ``aggregate`` over ``sequence``:
                         p0 = round(initial, 2);
                         p_i = round(clip(p_{i-1} * (1 + trend * 0.8^i), max(0.7 avg, 500), 1.3 avg), 2).
* ``forecast_bands``     +/-5 % bands and the confidence schedule 0.85 - 0.05 i.
* ``recommend``          (audience x trend direction) rules as a broadcast rule table.
* ``market_analysis``    one nested record per market.

Work per market is two partial aggregations (whole-series count/mean, newest-k tail via
WindowGroupLimit) joined on the market key; both sides hold one row per market, so the
join is small whatever the input size, and a hot market never lands in one task whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import trend_class
from ..session import stored
from .series import KEYS, PRICE, _keys, as_of_column, exact_mean, nth_last, price_sum, tail, usable

# Forecast constants of the app.
DAMPING = 0.8            # trend weight decays as 0.8 ** step
FLOOR_FACTOR = 0.7       # lower bound = max(0.7 * series mean, 500)
FLOOR_ABS = 500.0
CAP_FACTOR = 1.3         # upper bound = 1.3 * series mean
BAND_PCT = 0.05          # min/max bands = price * (1 -/+ 0.05)
CONF_START = 0.85        # confidence of the first step
CONF_STEP = 0.05         # ... decreasing by 0.05 per step
MIN_ROWS = 7             # a series needs 7 rows to be forecast


def series_summary(prices: DataFrame, k: int = 30, keys=KEYS, price_col: str = PRICE,
                   latest_cols=("state", "district", "variety")) -> DataFrame:
    """One row per series: count, mean, the latest row's fields and the newest-k tail values.

    Columns: n, series_avg, last_date, <latest_cols>, p1..p8 (newest prices), tail_min/max/avg
    over 7 and over k rows.
    """
    ks = _keys(keys)
    latest = F.max_by(F.struct("date", *latest_cols), F.struct("date", "id"))
    whole = (prices.groupBy(*ks)
             .agg(F.count(F.lit(1)).alias("n"), price_sum(price_col).alias("_s_all"),
                  F.count(usable(price_col)).alias("_n_all"), latest.alias("_latest"))
             .withColumn("series_avg", exact_mean("_s_all", "_n_all")))
    kk = max(k, 8)
    t = tail(prices, kk, ks, price_col)
    rn = F.col("_rn")
    p = F.col(price_col)
    u = usable(price_col)
    tails = (t.groupBy(*ks)
             .agg(*[nth_last("_rn", i, price_col).alias(f"p{i}") for i in range(1, 9)],
                  F.min(F.when(rn <= 7, p)).alias("min_7"),
                  F.max(F.when(rn <= 7, p)).alias("max_7"),
                  price_sum(F.when(rn <= 7, u)).alias("_s7"), F.count(F.when(rn <= 7, u)).alias("_n7"),
                  F.min(F.when(rn <= k, p)).alias(f"min_{k}"),
                  F.max(F.when(rn <= k, p)).alias(f"max_{k}"),
                  price_sum(F.when(rn <= k, u)).alias("_sk"), F.count(F.when(rn <= k, u)).alias("_nk"))
             .withColumns({"avg_7": exact_mean("_s7", "_n7"), f"avg_{k}": exact_mean("_sk", "_nk")}))
    out = whole.join(tails, ks)
    return out.select(*ks, "n", "series_avg", F.round("series_avg", 2).alias("series_avg_2"),
                      F.round("avg_7", 2).alias("avg_7_2"), F.col("_latest.date").alias("last_date"),
                      *[F.col(f"_latest.{c}").alias(c) for c in latest_cols],
                      *[f"p{i}" for i in range(1, 9)],
                      "min_7", "max_7", "avg_7", *([f"min_{k}", f"max_{k}", f"avg_{k}"] if k != 7 else []))


def price_trend(prices: DataFrame, rows: int = 30, keys=KEYS, price_col: str = PRICE) -> DataFrame:
    """Trend per series: change of the newest row vs the previous one, classified.

    Columns: keys, current_price, trend, min_{rows}d, max_{rows}d, avg_{rows}d, daily_change.
    A one-row series is Stable with daily_change 0.
    """
    ks = _keys(keys)
    t = tail(prices, max(rows, 2), ks, price_col)
    rn, p = F.col("_rn"), F.col(price_col)
    g = (t.groupBy(*ks)
         .agg(nth_last("_rn", 1, price_col).alias("current_price"),
              nth_last("_rn", 2, price_col).alias("_prev"),
              F.min(F.when(rn <= rows, p)).alias(f"min_{rows}d"),
              F.max(F.when(rn <= rows, p)).alias(f"max_{rows}d"),
              price_sum(F.when(rn <= rows, F.col(price_col))).alias("_s"),
              F.count(F.when(rn <= rows, usable(price_col))).alias("_n"))
         .withColumn(f"avg_{rows}d", exact_mean("_s", "_n")))
    change = F.try_divide(F.col("current_price") - F.col("_prev"), F.col("_prev")) * 100
    return g.select(*ks, "current_price",
                    trend_class(F.coalesce(change, F.lit(0.0))).alias("trend"),
                    f"min_{rows}d", f"max_{rows}d", f"avg_{rows}d",
                    F.coalesce(F.round(change, 2), F.lit(0.0)).alias("daily_change"))


def _feature_exprs(price_col: str = PRICE) -> dict[str, Column]:
    n = F.col("n")
    own = F.col("p1")
    d = F.col("last_date")
    return {
        "date": d, price_col: own,
        "day_of_year": F.dayofyear(d), "month": F.month(d), "year": F.year(d),
        "price_lag_1": F.when(n >= 2, F.col("p2")).otherwise(own),
        "price_lag_7": F.when(n >= 8, F.col("p8")).otherwise(own),
        "price_ma_7": F.when(n >= 7, F.col("avg_7")).otherwise(F.col("series_avg")),
        "price_ma_30": F.when(n >= 30, F.col("avg_30")).otherwise(F.col("series_avg")),
        "price_change_1": F.when(n >= 2, F.try_divide(own - F.col("p2"), F.col("p2"))).otherwise(F.lit(0.0)),
        "price_change_7": F.when(n >= 8, F.try_divide(own - F.col("p8"), F.col("p8"))).otherwise(F.lit(0.0)),
        "n_rows": n, "price_7_back": F.col("p7"),
        "price_ma_7_cents": F.when(n >= 7, F.col("avg_7_2")).otherwise(F.col("series_avg_2")),
    }


def features_from_summary(s: DataFrame, keys=KEYS, price_col: str = PRICE) -> DataFrame:
    """Feature columns of the newest row of every series, from a ``series_summary`` frame.

    Short-history defaults: lag_1 / lag_7 fall back to the row's own price, the 7/30-row
    means to the mean of all rows, changes to 0.
    """
    ks = _keys(keys)
    return s.select(*ks, "state", "district", "variety", "series_avg",
                    *[c.alias(n) for n, c in _feature_exprs(price_col).items()])


def latest_feature_row(prices: DataFrame, keys=KEYS, price_col: str = PRICE, min_rows: int = MIN_ROWS) -> DataFrame:
    """The feature row the predictor scores: newest row + lags, means and changes, for every
    series with at least ``min_rows`` rows."""
    ks = _keys(keys)
    return features_from_summary(series_summary(prices, 30, ks, price_col), ks, price_col) \
        .filter(F.col("n_rows") >= min_rows)


def initial_prediction(latest: DataFrame, model=None, fallback_col: str = "price_ma_7_cents") -> DataFrame:
    """Model prediction for each latest row; the 7-row mean (exact, in cents) where the model
    gives none.

    ``model`` is a fitted Spark ML ``PipelineModel`` whose output column is ``prediction``
    (see ``operators.ml``); None means the fallback path for every series.
    """
    if model is None:
        return latest.withColumn("initial_price", F.col(fallback_col))
    scored = model.transform(latest)
    return scored.withColumn("initial_price", F.coalesce(F.col("prediction"), F.col(fallback_col))).drop("prediction")


def _noise(keys: list[str], step: Column, amplitude: float, seed: int) -> Column:
    """Repeatable noise in [-amplitude, amplitude) from a hash of (series, step, seed)."""
    h = F.abs(F.xxhash64(*[F.col(k) for k in keys], step, F.lit(seed))) % 1_000_000
    return (h.cast("double") / 500_000 - 1) * amplitude


def damped_path(p0: Column, trend: Column, lo: Column, hi: Column, horizon: int,
                noise=None) -> Column:
    """array<double> of ``horizon`` prices: the app's damped-trend recursion as one fold."""
    if horizon <= 1:
        return F.array(p0)
    noise = noise or (lambda i: F.lit(0.0))

    def step(acc, i):
        nxt = F.element_at(acc, -1) * (F.lit(1.0) + trend * F.pow(F.lit(DAMPING), i) + noise(i))
        return F.concat(acc, F.array(F.round(F.greatest(F.least(nxt, hi), lo), 2)))

    return F.aggregate(F.sequence(F.lit(1), F.lit(horizon - 1)), F.array(p0), step)


def forecast_paths(latest: DataFrame, horizon: int = 7, noise: float = 0.0, seed: int = 0, keys=KEYS,
                   price_col: str = PRICE, model=None) -> DataFrame:
    """Per series (feature rows from ``features_from_summary``): initial price, trend, bounds
    and ``path`` = array of ``horizon`` predicted prices."""
    ks = _keys(keys)
    scored = initial_prediction(latest, model)
    trend = F.try_divide(F.col(price_col) - F.col("price_7_back"), F.col("price_7_back"))
    lo = F.greatest(F.col("series_avg") * FLOOR_FACTOR, F.lit(FLOOR_ABS))
    hi = F.col("series_avg") * CAP_FACTOR
    nz = (lambda i: _noise(ks, i, noise, seed)) if noise else None
    base = scored.select("*", F.round("initial_price", 2).alias("_p0"), F.coalesce(trend, F.lit(0.0)).alias("trend"),
                         lo.alias("lower_bound"), hi.alias("upper_bound")) \
        .drop("initial_price").withColumnRenamed("_p0", "initial_price")
    path = damped_path(F.col("initial_price"), F.col("trend"), F.col("lower_bound"), F.col("upper_bound"), horizon, nz)
    return base.withColumn("path", path)


def forecast_7d(prices: DataFrame, as_of=None, horizon: int = 7, noise: float = 0.0, seed: int = 0,
                keys=KEYS, price_col: str = PRICE, model=None, window_days: int | None = 730) -> DataFrame:
    """Forecast ``horizon`` days for every series with at least 7 rows.

    Rows: keys, step (0-based), date (= as_of + 1 + step), predicted_price, plus the inputs
    (initial_price, trend, lower/upper bound).  ``as_of`` defaults to the table's max date;
    ``window_days`` restricts history to the app's 2-year load window.
    """
    ks = _keys(keys)
    a = as_of_column(prices, as_of)
    hist = prices
    if window_days:
        hist = prices.filter((F.col("date") >= F.date_sub(a, window_days)) & (F.col("date") <= a))
    return forecast_from_summary(series_summary(hist, 30, ks, price_col), a, horizon, noise, seed, ks, price_col, model)


def market_summary(prices: DataFrame, as_of=None, keys=KEYS, price_col: str = PRICE, window_days: int = 730) -> DataFrame:
    """``series_summary`` of the load window, written once (one row per series): trend and forecast read it, so the
    windows over the prices are planned and run once."""
    a = as_of_column(prices, as_of)
    hist = prices.filter((F.col("date") >= F.date_sub(a, window_days)) & (F.col("date") <= a))
    return stored(series_summary(hist, 30, keys, price_col), "summary")


def trend_from_summary(s: DataFrame, keys=KEYS) -> DataFrame:
    """``price_trend`` from a summary row: keys, current_price, trend, daily_change."""
    change = F.try_divide(F.col("p1") - F.col("p2"), F.col("p2")) * 100
    return s.select(*_keys(keys), F.col("p1").alias("current_price"), trend_class(F.coalesce(change, F.lit(0.0))).alias("trend"),
                    F.coalesce(F.round(change, 2), F.lit(0.0)).alias("daily_change"))


def forecast_from_summary(s: DataFrame, as_of: Column, horizon: int = 7, noise: float = 0.0, seed: int = 0, keys=KEYS,
                          price_col: str = PRICE, model=None) -> DataFrame:
    """``forecast_7d`` from a summary row."""
    ks = _keys(keys)
    rows = features_from_summary(s, ks, price_col).filter(F.col("n_rows") >= MIN_ROWS)
    fp = forecast_paths(rows, horizon, noise, seed, ks, price_col, model)
    return (fp.select(*ks, "initial_price", "trend", "lower_bound", "upper_bound", F.posexplode("path").alias("step", "predicted_price"))
            .withColumn("date", F.date_add(as_of, F.col("step") + 1)))


def forecast_bands(fc: DataFrame, pct: float = BAND_PCT) -> DataFrame:
    """min/max bands (rounded to cents) and the decreasing confidence schedule."""
    p = F.col("predicted_price")
    return fc.withColumns({
        "min_price": F.round(p * (1 - pct), 2),
        "max_price": F.round(p * (1 + pct), 2),
        "confidence": F.round(F.lit(CONF_START) - F.lit(CONF_STEP) * F.col("step"), 2),
    })


# Advice rules per audience and trend direction (type, message, confidence, action).
ADVICE_RULES = [
    ("FARMER", "up", "SELL", "Prices are increasing. Consider selling now to maximize profits.", "High", "Sell within 1-2 days"),
    ("FARMER", "down", "HOLD", "Prices are decreasing. Consider storing for better prices.", "Medium", "Wait 5-7 days and monitor"),
    ("FARMER", "flat", "MONITOR", "Prices are stable. Monitor market for 2-3 days.", "Low", "Check again in 2-3 days"),
    ("TRADER", "up", "BUY", "Prices trending up. Good time to buy for short-term trade.", "High", None),
    ("TRADER", "down", "SELL", "Prices trending down. Sell existing stock.", "Medium", None),
    ("TRADER", "flat", "HOLD", "Market stable. Maintain current position.", "Low", None),
    ("CONSUMER", "down", "DELAY_BUY", "Prices decreasing. Wait for better prices.", "High", "Wait 3-4 days before buying"),
    ("CONSUMER", "up", "BUY_NOW", "Prices increasing. Buy now to avoid higher prices.", "High", "Purchase within 1-2 days"),
    ("CONSUMER", "flat", "NORMAL_BUY", "Prices stable. Normal buying recommended.", "Medium", "Buy as needed"),
]
# The extra farmer rule when the forecast mean exceeds the current price by 5 %.
DELAY_SELL = ("DELAY_SELL", "Prices expected to rise to ₹%.2f in next week", "Medium", "Consider waiting 3-4 days")
DELAY_SELL_FACTOR = 1.05
ADVICE_SCHEMA = "user_type string, direction string, type string, message string, confidence string, action string"


def trend_direction(trend) -> Column:
    t = F.col(trend) if isinstance(trend, str) else trend
    return (F.when(t.isin("Increasing", "Increasing Rapidly"), "up")
            .when(t.isin("Decreasing", "Decreasing Rapidly"), "down").otherwise("flat"))


def advice_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ADVICE_RULES, ADVICE_SCHEMA)


def recommend(trend: DataFrame, forecast: DataFrame | None, user_types=("FARMER", "TRADER", "CONSUMER"),
              keys=KEYS) -> DataFrame:
    """Advice rows per (series, audience): the rule for the series' trend direction, plus
    DELAY_SELL for farmers when the mean forecast is above 1.05 x the current price.

    The rule table is a fixed nine-row literal, so broadcasting it is bounded.
    """
    ks = _keys(keys)
    spark = trend.sparkSession
    rules = advice_rules(spark).filter(F.col("user_type").isin(list(user_types)))
    base = trend.select(*ks, "trend", "current_price", trend_direction("trend").alias("direction"))
    out = (base.join(F.broadcast(rules), "direction")
           .select(*ks, "user_type", "trend", "type", "message", "confidence", "action", F.lit(0).alias("rule_order")))
    if forecast is not None and "FARMER" in user_types:
        avg_fc = (forecast.groupBy(*ks)
                  .agg(price_sum("predicted_price").alias("_s"), F.count(usable("predicted_price")).alias("_n"))
                  .select(*ks, exact_mean("_s", "_n").alias("avg_predicted")))
        extra = (base.join(avg_fc, ks)
                 .filter(F.col("avg_predicted") > F.col("current_price") * DELAY_SELL_FACTOR)
                 .select(*ks, F.lit("FARMER").alias("user_type"), "trend", F.lit(DELAY_SELL[0]).alias("type"),
                         F.format_string(DELAY_SELL[1], F.col("avg_predicted")).alias("message"),
                         F.lit(DELAY_SELL[2]).alias("confidence"), F.lit(DELAY_SELL[3]).alias("action"),
                         F.lit(1).alias("rule_order")))
        out = out.unionByName(extra)
    return out


# Analysis error texts.
MSG_NOT_FOUND = "Market '%s' not found in data"
MSG_INSUFFICIENT = "Insufficient data for "


def market_analysis(prices: DataFrame, as_of=None, horizon: int = 7, keys=KEYS, price_col: str = PRICE,
                    model=None, pct: float = BAND_PCT, market: str | None = None) -> DataFrame:
    """One record per market: latest fields, 7-row statistics, weekly change, the forecast
    as ``array<struct>`` and the market's own trend.  Markets under 7 rows carry ``error``.

    Everything comes from one per-market summary (one tail window + one partial aggregate);
    the forecast array is built in place with ``transform``, so there is no explode/collect
    round trip and no second shuffle.
    """
    ks = _keys(keys)
    a = as_of_column(prices, as_of)
    if market is not None:
        prices = prices.filter(F.col(ks[0]) == F.lit(market))
    hist = prices.filter((F.col("date") >= F.date_sub(a, 730)) & (F.col("date") <= a))
    s = series_summary(hist, 30, ks, price_col)
    # features and path are added to the summary itself: one frame, no self-join
    s = forecast_paths(s.withColumns(_feature_exprs(price_col)), horizon, keys=ks, price_col=price_col, model=model)
    enough = F.col("n") >= MIN_ROWS
    weekly = F.round(F.try_divide(F.col("p1") - F.col("p7"), F.col("p7")) * 100, 2)
    change = F.try_divide(F.col("p1") - F.col("p2"), F.col("p2")) * 100
    trend_struct = F.struct(F.col("p1").alias("current_price"),
                            trend_class(F.coalesce(change, F.lit(0.0))).alias("trend"),
                            F.col("min_30").alias("min_30d"), F.col("max_30").alias("max_30d"),
                            F.col("avg_30").alias("avg_30d"),
                            F.coalesce(F.round(change, 2), F.lit(0.0)).alias("daily_change"))
    # (a subquery cannot sit inside a lambda, so as_of travels as a column)
    preds = F.transform(F.col("path"), lambda p, i: F.struct(
        F.date_add(F.col("_as_of"), i + 1).alias("date"), p.alias("predicted_price"),
        F.round(p * (1 - pct), 2).alias("min_price"), F.round(p * (1 + pct), 2).alias("max_price"),
        F.round(F.lit(CONF_START) - F.lit(CONF_STEP) * i, 2).alias("confidence")))
    out = (s.withColumn("_as_of", a)
           .select(*ks,
                    F.when(enough, F.col("p1")).alias("current_price"),
                    F.when(enough, F.date_format("last_date", "yyyy-MM-dd")).alias("current_date"),
                    F.when(enough, F.col("state")).alias("state"),
                    F.when(enough, F.col("district")).alias("district"),
                    F.when(enough, F.col("variety")).alias("variety"),
                    F.when(enough, F.struct(F.col("min_7").alias("min_7d"), F.col("max_7").alias("max_7d"),
                                            F.col("avg_7").alias("avg_7d"))).alias("price_stats"),
                    F.when(enough, weekly).alias("weekly_change"),
                    F.when(enough, preds).alias("predictions"),
                    F.when(enough, trend_struct).alias("trend"),
                    F.when(~enough, F.concat(F.lit(MSG_INSUFFICIENT), F.col(ks[0]))).alias("error")))
    if market is not None:
        # a requested market without rows still gets its record, carrying the error
        asked = prices.sparkSession.createDataFrame([(market,)], f"{ks[0]} string")
        missing = asked.join(out.select(ks[0]), ks[0], "left_anti")
        out = out.unionByName(missing.withColumn("error", F.lit(MSG_NOT_FOUND % market)), allowMissingColumns=True)
    return out
