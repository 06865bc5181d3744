"""Page-level compositions (survey 2.12: home and dashboard summaries).

Each section is a bounded top-k or a per-market aggregate; sections are stacked with
``unionByName`` into one (section, ...) frame instead of being collected one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .forecast import forecast_from_summary, market_summary, trend_from_summary
from .selection import top_recent
from .series import as_of_column


def _count_row(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.lit(name).alias("section"), F.lit(None).cast("bigint").alias("item_id"),
                  F.lit(None).cast("string").alias("label"), F.count(F.lit(1)).cast("double").alias("value"))


def home_summary(prices: DataFrame, factors: DataFrame, predictions: DataFrame, n_prices: int = 10,
                 n_factors: int = 5, n_predictions: int = 7) -> DataFrame:
    recent = top_recent(prices, n_prices).select(F.lit("recent_price").alias("section"), F.col("id").alias("item_id"),
                                                 F.col("market").alias("label"), F.col("modal_price").alias("value"))
    active = factors.filter("is_active")
    fac = active.orderBy("id").limit(n_factors).select(F.lit("factor").alias("section"), F.col("id").alias("item_id"),
                                                        F.col("name").alias("label"), F.col("impact_score").alias("value"))
    pred = top_recent(predictions, n_predictions, "forecast_date").select(
        F.lit("prediction").alias("section"), F.col("id").alias("item_id"), F.col("market").alias("label"),
        F.col("predicted_modal_price").alias("value"))
    return (recent.unionByName(fac).unionByName(pred)
            .unionByName(_count_row(prices, "total_prices"))
            .unionByName(_count_row(active, "total_factors"))
            .unionByName(_count_row(predictions, "total_predictions")))


def dashboard_summary(prices: DataFrame, factors: DataFrame, n_factors: int = 5, as_of=None, horizon: int = 7, model=None) -> DataFrame:
    """Per-market trend rows, the forecast of the next days (text: the day) and the first active factors.  Trend and
    forecast come from one stored summary row per market."""
    a = as_of_column(prices, as_of)
    s = market_summary(prices, as_of)
    tr = trend_from_summary(s).select(F.lit("trend").alias("section"), F.col("market").alias("label"),
                                      F.col("trend").alias("text"), F.col("current_price").alias("value"))
    days = forecast_from_summary(s, a, horizon, model=model).select(
        F.lit("prediction").alias("section"), F.col("market").alias("label"), F.date_format("date", "yyyy-MM-dd").alias("text"),
        F.col("predicted_price").alias("value"))
    fac = factors.filter("is_active").orderBy("id").limit(n_factors).select(
        F.lit("factor").alias("section"), F.col("name").alias("label"), F.col("factor_type").alias("text"),
        F.col("impact_score").alias("value"))
    return tr.unionByName(days).unionByName(fac)


def historical_data(prices: DataFrame, market=None, start=None, end=None) -> DataFrame:
    """The history page: one market (case-insensitive), optional date range, newest first."""
    from ..functions import predicates as P
    return (prices.filter(P.iexact("market", market) & P.date_range("date", start, end))
            .orderBy(F.col("date").desc(), F.col("id").desc()))


def prediction_results(predictions: DataFrame, market=None, date_range: str = "all", status: str = "all",
                       as_of=None, limit: int = 100) -> DataFrame:
    """The results page: market (case-insensitive), prediction made within the last
    week/month/quarter, verified/pending, newest forecast first, first ``limit`` rows."""
    from ..functions import predicates as P
    a = as_of_column(predictions, as_of, "prediction_date")
    f = (P.iexact("market", market) & P.relative_range("prediction_date", date_range, a)
         & P.status("actual_price", status))
    return top_recent(predictions.filter(f), limit, "forecast_date")


def generate_predictions(prices: DataFrame, path: str, as_of=None, horizon: int = 7, market=None,
                         model=None, model_id=None) -> DataFrame:
    """The generate-predictions job: history guards (>= 30 rows in the load window of the whole table, whatever
    ``market`` asks for; series >= 7 rows), forecast every qualifying market (or those matching ``market``), append
    the rows to the predictions table at ``path``, and return what was written."""
    from ..functions import predicates as P
    from ..sources.files import to_prediction_rows
    from .forecast import forecast_7d
    from .series import MIN_TOTAL_ROWS, load_recent_window
    a = as_of_column(prices, as_of)
    hist = load_recent_window(prices, a)
    enough = hist.agg(F.count(F.lit(1))).scalar() >= MIN_TOTAL_ROWS
    fc = forecast_7d(hist.filter(P.contains("market", market)), a, horizon, model=model, window_days=None).filter(enough)
    rows = to_prediction_rows(fc, a, model_id)
    rows.write.mode("append").partitionBy("prediction_date").parquet(path)
    # read back with the known schema: a guarded-out run writes no data files at all
    return fc.sparkSession.read.schema(rows.schema).parquet(path)


def training_report(prices: DataFrame, models=("lr", "rf", "xgb"), frac: float = 0.8, **params) -> DataFrame:
    """The training job's report: data profile, per-model test metrics on a chronological split
    of leak-free features, the tomorrow-equals-today baseline on the same test rows, and the
    best model — stacked as (section, name, value) rows."""
    from .aggregates import profile_date_span, profile_numeric, regression_metrics
    from .encode import build_features_simple
    from .ml import SIMPLE_FEATURES, stored_split, train_all
    feats, _ = build_features_simple(prices, leak_free=True, encode=False)
    split = stored_split(feats, SIMPLE_FEATURES, frac=frac)
    fitted, metrics = train_all(split, SIMPLE_FEATURES, models=models, held=True, **params)
    base = regression_metrics(split.filter("NOT is_train").withColumn("prediction", F.col("price_lag_1")), "modal_price", "prediction") \
        .withColumn("model", F.lit("baseline"))
    allm = stored(metrics.unionByName(base), "metrics")  # the rows below read it: every model scores the test rows once
    rows = allm.select(F.lit("metric").alias("section"), F.concat_ws(".", "model", F.lit("r2")).alias("name"),
                       F.col("r2").alias("value"))
    rows = rows.unionByName(allm.select(F.lit("metric").alias("section"),
                                        F.concat_ws(".", "model", F.lit("mae")).alias("name"),
                                        F.col("mae").alias("value")))
    best = (allm.filter("model <> 'baseline'").orderBy(F.col("r2").desc(), "model").limit(1)
            .select(F.lit("best").alias("section"), F.col("model").alias("name"), F.col("r2").alias("value")))
    prof = profile_numeric(prices).unpivot([], ["min", "max", "mean", "median", "std"], "name", "value") \
        .select(F.lit("profile").alias("section"), "name", "value")
    span = profile_date_span(prices).select(F.lit("profile").alias("section"), F.lit("days").alias("name"),
                                            F.col("total_days").cast("double").alias("value"))
    return rows.unionByName(best).unionByName(prof).unionByName(span)
