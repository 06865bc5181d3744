"""Aggregations (section 2.6): dashboard counters, statistics, profiles, model metrics.

Counters that the app computes with several COUNT queries are one pass of conditional
aggregates here (``count_if``), which Spark evaluates as a partial + final hash aggregate.
Totals over several tables are scalar subqueries, never a cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.scalars import accuracy_value, confidence_band
from .series import as_of_column, exact_mean, price_sum, usable


def price_mean(col: str = "modal_price") -> list[Column]:
    """Aggregates for an exact mean: (whole sums, count); finish with ``finish_mean``."""
    return [price_sum(col).alias(f"_s_{col}"), F.count(usable(col)).alias(f"_n_{col}")]


def finish_mean(df: DataFrame, name: str, col: str = "modal_price", default=None) -> DataFrame:
    m = exact_mean(f"_s_{col}", f"_n_{col}")
    if default is not None:
        m = F.coalesce(m, F.lit(default))
    return df.withColumn(name, m).drop(f"_s_{col}", f"_n_{col}")


def _count() -> Column:
    return F.count(F.lit(1))


def dashboard_totals(prices: DataFrame, predictions: DataFrame, users: DataFrame) -> DataFrame:
    """counts of prices / predictions / users and the mean modal price (0 when empty)."""
    g = finish_mean(prices.agg(_count().alias("total_prices"), *price_mean()), "avg_price", default=0.0)
    return (g.select("total_prices",
                    predictions.agg(_count()).scalar().alias("total_predictions"),
                    users.agg(_count()).scalar().alias("total_users"),
                    "avg_price"))


def price_stats(prices: DataFrame) -> DataFrame:
    """total, mean, and the rows with the highest / lowest modal price (ties: lowest id)."""
    row = F.struct("id", "date", "market", "modal_price")
    hi = F.max_by(row, F.struct("modal_price", (-F.col("id")).alias("nid")))
    lo = F.min_by(row, F.struct("modal_price", "id"))
    g = finish_mean(prices.agg(_count().alias("total_records"), *price_mean(), hi.alias("hi"), lo.alias("lo")),
                    "avg_price", default=0.0)
    return g.select("total_records", "avg_price",
                    *[F.col(f"{s}.{c}").alias(f"{n}_{c}") for s, n in (("hi", "highest"), ("lo", "lowest"))
                      for c in ("id", "date", "market", "modal_price")])


def price_change_pct(prices: DataFrame, start, end) -> DataFrame:
    """Mean price over [start, start+1] vs over [end-1, end]: round(change / start * 100, 2);
    0 when the start mean is missing or not positive.  One pass, two conditional means."""
    s = F.lit(start).cast("date") if not isinstance(start, Column) else start
    e = F.lit(end).cast("date") if not isinstance(end, Column) else end
    d = F.col("date")
    u = usable("modal_price")
    in_s, in_e = d.between(s, F.date_add(s, 1)), d.between(F.date_sub(e, 1), e)
    g = prices.agg(price_sum(F.when(in_s, u)).alias("_ss"), F.count(F.when(in_s, u)).alias("_ns"),
                   price_sum(F.when(in_e, u)).alias("_se"), F.count(F.when(in_e, u)).alias("_ne"))
    g = g.select(exact_mean("_ss", "_ns").alias("start_avg"), exact_mean("_se", "_ne").alias("end_avg"))
    sa, ea = F.coalesce("start_avg", F.lit(0.0)), F.coalesce("end_avg", F.lit(0.0))
    return g.select(sa.alias("start_avg"), ea.alias("end_avg"),
                    F.when(sa > 0, F.round((ea - sa) / sa * 100, 2)).otherwise(F.lit(0.0)).alias("price_change_pct"))


def prediction_stats(predictions: DataFrame, as_of=None, high: float = 80) -> DataFrame:
    a = as_of_column(predictions, as_of, "forecast_date")
    return predictions.agg(
        _count().alias("total_predictions"),
        F.coalesce(F.avg("confidence_interval"), F.lit(0.0)).alias("avg_confidence"),
        F.count_if(F.col("confidence_interval") >= high).alias("high_confidence_predictions"),
        F.count_if(F.col("forecast_date") >= F.date_sub(a, 7)).alias("predictions_last_7_days"))


def predictions_per_day(predictions: DataFrame, as_of=None) -> DataFrame:
    a = as_of_column(predictions, as_of, "forecast_date")
    n = F.count_if(F.col("forecast_date") >= F.date_sub(a, 7))
    return predictions.agg(F.round(n / 7, 1).alias("predictions_per_day"))


def confidence_distribution(predictions: DataFrame, high: float = 80, mid: float = 60) -> DataFrame:
    level = confidence_band("confidence_interval", high, mid, labels=("high", "medium", "low"))
    return (predictions.groupBy(level.alias("confidence_level"))
            .agg(_count().alias("predictions")))


def avg_accuracy(predictions: DataFrame) -> DataFrame:
    """Mean accuracy over rows with non-zero actual and predicted prices; 1 decimal; 0 if none."""
    acc = accuracy_value("predicted_modal_price", "actual_price")
    return predictions.agg(F.coalesce(F.round(F.avg(acc), 1), F.lit(0.0)).alias("avg_accuracy"),
                           F.count(acc).alias("scored_predictions"))


def verification_stats(predictions: DataFrame) -> DataFrame:
    return predictions.agg(
        F.count("actual_price").alias("verified"),
        F.count_if(F.col("actual_price").isNull()).alias("pending"),
        _count().alias("total"),
        F.round(F.coalesce(F.avg("confidence_interval"), F.lit(0.0)), 1).alias("avg_confidence"))


def user_stats(users: DataFrame, as_of=None) -> DataFrame:
    """total; active = logged in within 30 days; joined on as_of; joined within 7 days.
    Dates compare as DATE, both ends inclusive."""
    a = as_of_column(users, as_of, "last_login").cast("date")
    joined = F.col("date_joined").cast("date")
    return users.agg(
        _count().alias("total_users"),
        F.count_if(F.col("last_login").cast("date") >= F.date_sub(a, 30)).alias("active_users"),
        F.count_if(joined == a).alias("new_users_today"),
        F.count_if(joined >= F.date_sub(a, 7)).alias("new_users_week"))


def factor_stats(factors: DataFrame, high: float = 70) -> DataFrame:
    g = factors.agg(_count().alias("total_factors"),
                    F.count_if(F.col("is_active")).alias("active_count"),
                    F.avg("impact_score").alias("_avg"),
                    F.count_if(F.col("impact_score") >= high).alias("high_impact_count"))
    pct = F.when(F.col("total_factors") > 0, F.round(F.col("active_count") / F.col("total_factors") * 100, 1))
    return g.select("total_factors", "active_count", F.coalesce(pct, F.lit(0.0)).alias("active_percentage"),
                    F.round(F.coalesce("_avg", F.lit(0.0)), 1).alias("avg_impact_score"), "high_impact_count")


def message_stats(messages: DataFrame, search: str | None = None) -> DataFrame:
    m = messages.filter(P.search_any(["name", "email", "subject"], search))
    return m.agg(_count().alias("total_count"), F.count_if(F.col("subscribed_to_alerts")).alias("alert_subscribers"))


def facet_values(df: DataFrame, col: str, drop_empty: bool = False) -> DataFrame:
    out = df.select(col).distinct()
    if drop_empty:
        out = out.filter(F.col(col).isNotNull() & (F.col(col) != ""))
    return out.orderBy(col)


def exact_quantile(df: DataFrame, col: str, q: float = 0.5) -> Column:
    """Exact interpolated quantile (``quantile_cont``) of the values that are neither null nor NaN.

    The one or two values at the wanted places come from rank selection (``ranks.keys_at``): passes of partial
    counts that narrow the range holding a place, so no task or driver holds more than a bounded number of values.
    Returns the value as a literal Column (a scalar computed by a few bounded jobs)."""
    from .ranks import keys_at
    vals = df.select(F.col(col).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    n = vals.count()
    if not n:
        return F.lit(None).cast("double")
    place = (n - 1) * q
    k = int(place)
    (v1,), (v2,), _ = keys_at(vals, [("v", True)], k, k + 1 if place > k else k, n)
    return F.lit(v1 + (v2 - v1) * (place - k))


def profile_numeric(df: DataFrame, col: str = "modal_price", exact_median: bool = True) -> DataFrame:
    """min / max / mean / median / sample std of one column.

    ``exact_median`` uses ``exact_quantile`` (bounded tasks); otherwise ``percentile_approx``.
    """
    med = exact_quantile(df, col, 0.5) if exact_median else F.percentile_approx(col, 0.5, 10000).cast("double")
    g = df.agg(F.min(col).alias("min"), F.max(col).alias("max"), *price_mean(col), med.alias("median"),
               F.stddev_samp(col).alias("std"))
    return finish_mean(g, "mean", col).select("min", "max", "mean", "median", "std")


def profile_cardinality(df: DataFrame, cols=("market", "state"), approx: bool = False) -> DataFrame:
    f = (lambda c: F.approx_count_distinct(c)) if approx else (lambda c: F.count_distinct(c))
    return df.agg(*[f(c).alias(f"unique_{c}") for c in cols])


def profile_missing(df: DataFrame) -> DataFrame:
    """(column, missing) for every column with at least one null — one pass, then unpivot."""
    g = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    long = g.unpivot([], df.columns, "column", "missing")
    return long.filter(F.col("missing") > 0)


def profile_date_span(df: DataFrame, col: str = "date") -> DataFrame:
    g = df.agg(F.min(col).alias("first_date"), F.max(col).alias("last_date"))
    return g.withColumn("total_days", F.datediff("last_date", "first_date"))


def avg_price_by_market(prices: DataFrame, keys=("market",), price_col: str = "modal_price") -> DataFrame:
    g = prices.groupBy(*keys).agg(*price_mean(price_col), _count().alias("n"))
    return finish_mean(g, "avg_price", price_col).select(*keys, "avg_price", "n")


def low_cardinality_check(df: DataFrame, cols=("market", "state", "variety"), limit: int = 20) -> DataFrame:
    """Distinct counts in one pass, unpivoted: (column, distinct_values, below_limit)."""
    g = df.agg(*[F.count_distinct(c).alias(c) for c in cols])
    long = g.unpivot([], list(cols), "column", "distinct_values")
    return long.withColumn("below_limit", F.col("distinct_values") < limit)


def regression_metrics(df: DataFrame, y: str = "modal_price", p: str = "prediction", by=None) -> DataFrame:
    """MSE, MAE, R^2 (1 - SSE / (n var_pop(y))), mean actual and mean predicted; rows with
    a missing actual or prediction are skipped."""
    d = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull())
    err = F.col(y) - F.col(p)
    aggs = [F.avg(err * err).alias("mse"), F.avg(F.abs(err)).alias("mae"),
            (F.lit(1.0) - F.try_divide(F.sum(err * err), _count() * F.var_pop(y))).alias("r2"),
            F.avg(y).alias("mean_actual"), F.avg(p).alias("mean_predicted"), _count().alias("n")]
    return d.groupBy(*by).agg(*aggs) if by else d.agg(*aggs)


def metrics_by_column(df: DataFrame, predictions, y: str = "modal_price") -> DataFrame:
    """``regression_metrics`` of several prediction columns as one row each (``model`` = the column): the rows are
    computed once and stacked, not read again for every column."""
    long = df.select(y, *predictions).unpivot([y], list(predictions), "model", "prediction")
    return regression_metrics(long, y, "prediction", by=["model"])


def select_best_model(metrics: DataFrame, name: str = "model", r2: str = "r2") -> DataFrame:
    """The model with the highest R^2 (ties: first name) and the verdict on the set."""
    g = metrics.agg(F.min_by(name, F.struct((-F.col(r2)).alias("neg_r2"), F.col(name))).alias("best_model"),
                    F.max(r2).alias("best_r2"), F.bool_and(F.col(r2) < 0).alias("all_negative"))
    verdict = (F.when(F.col("all_negative"), "all negative").when(F.col("best_r2") > 0.5, "good")
               .when(F.col("best_r2") > 0, "weak").otherwise("none positive"))
    return g.withColumn("verdict", verdict)
