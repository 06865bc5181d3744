"""Row selection, projection, joins, ordering and paging (survey 2.3, 2.4, 2.5, 2.8).

Joins: the app only has key equi-joins.  Sides whose size is fixed by definition (rule
tables) are broadcast; everything else is left to
Spark's size-checked planning (``autoBroadcastJoinThreshold`` on estimated size, and AQE
re-planning on measured shuffle sizes), which falls back to a sort-merge join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.scalars import accuracy_value, default_value
from .ranks import before, keys_at, order_of, same, sort_columns

# ----------------------------------------------------------------------------- filters

# Lists up to this many literals are an IN-list (pushed to the scan); larger sets join.
ISIN_LIMIT = 1000


def filter_in(df: DataFrame, col: str, ids) -> DataFrame:
    """Rows whose ``col`` is in ``ids``: a small list is an IN predicate, a DataFrame a semi join."""
    if isinstance(ids, DataFrame):
        other = ids.select(F.col(ids.columns[0]).alias(col)).distinct()
        return df.join(other, col, "left_semi")
    ids = list(ids)
    if len(ids) <= ISIN_LIMIT:
        return df.filter(F.col(col).isin(ids))
    other = df.sparkSession.createDataFrame([(i,) for i in ids], [col])
    return df.join(other, col, "left_semi")


def drop_incomplete(df: DataFrame, subset=None) -> DataFrame:
    return df.na.drop("any", subset=subset)


def filter_prices(df: DataFrame, market=None, match: str = "contains", state=None, start=None, end=None) -> DataFrame:
    """The price list filters: market (contains/iexact/exact), state contains, date range."""
    return df.filter(P.match("market", market, match) & P.contains("state", state) & P.date_range("date", start, end))


def filter_predictions(df: DataFrame, market=None, match: str = "contains", start=None, end=None,
                       confidence: str | None = None) -> DataFrame:
    return df.filter(P.match("market", market, match) & P.date_range("forecast_date", start, end)
                     & P.confidence("confidence_interval", confidence or ""))


# ----------------------------------------------------------------------------- projections

PRICE_VIEW = ["date", "market", "modal_price", "min_price", "max_price"]


def project_prices(df: DataFrame, cols=PRICE_VIEW) -> DataFrame:
    return df.select(*cols)


def drop_columns(df: DataFrame, *cols: str) -> DataFrame:
    return df.drop(*cols)


def prediction_details(predictions: DataFrame, models: DataFrame) -> DataFrame:
    """Every prediction as a detail record: ``success`` and the nested ``prediction`` with defaults for missing
    values, the model as a record of its own, the time of creation in ISO form, accuracy and absolute difference
    (0 when either price is missing or zero)."""
    j = join_prediction_model(predictions, models)
    acc = accuracy_value("predicted_modal_price", "actual_price")
    ok = acc.isNotNull()
    return j.select(F.lit(True).alias("success"), F.struct(
        "id",
        default_value("market", "-").alias("market"),
        F.date_format("forecast_date", "yyyy-MM-dd").alias("forecast_date"),
        F.coalesce("predicted_min_price", F.lit(0.0)).alias("predicted_min_price"),
        F.coalesce("predicted_modal_price", F.lit(0.0)).alias("predicted_modal_price"),
        F.coalesce("predicted_max_price", F.lit(0.0)).alias("predicted_max_price"),
        F.coalesce("confidence_interval", F.lit(0.0)).alias("confidence_interval"),
        F.when(F.col("actual_price") != 0, F.col("actual_price")).alias("actual_price"),
        F.struct(F.coalesce("model_name", F.lit("N/A")).alias("name")).alias("model_used"),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
        F.coalesce(acc, F.lit(0.0)).alias("accuracy"),
        F.when(ok, F.abs(F.col("predicted_modal_price") - F.col("actual_price"))).otherwise(F.lit(0.0)).alias("difference")).alias("prediction"))


# ----------------------------------------------------------------------------- joins

def join_users_profiles(users: DataFrame, profiles: DataFrame, user_type=None) -> DataFrame:
    """Users with a profile, optionally of one type (inner 1:1 on user_id)."""
    j = users.join(profiles, "user_id", "inner")
    return j.filter(P.exact("user_type", user_type))


def join_user_type_default(users: DataFrame, profiles: DataFrame, default="GENERAL") -> DataFrame:
    """Every user with its profile type; a missing profile gives ``default``."""
    p = profiles.select("user_id", "user_type")
    j = users.join(p, "user_id", "left")
    return j.withColumn("user_type", F.coalesce("user_type", F.lit(default)) if default is not None else F.col("user_type"))


def join_prediction_model(predictions: DataFrame, models: DataFrame) -> DataFrame:
    """Predictions with the model's name (left join on the nullable key) — one join instead of
    a lookup per row.  The model registry grows with training runs, not with data, but has no
    hard bound, so no hint: Spark's size check broadcasts it while it is small."""
    m = models.select(F.col("id").alias("model_used_id"), F.col("name").alias("model_name"))
    return predictions.join(m, "model_used_id", "left")


def join_search_username(users: DataFrame, profiles: DataFrame, text) -> DataFrame:
    """Profiles whose user's name contains ``text``."""
    u = users.select("user_id", "username").filter(P.contains("username", text))
    return profiles.join(u, "user_id", "inner")


def semi_existing(df: DataFrame, other: DataFrame, keys) -> DataFrame:
    return df.join(other.select(*keys), list(keys), "left_semi")


def anti_new(df: DataFrame, other: DataFrame, keys) -> DataFrame:
    return df.join(other.select(*keys), list(keys), "left_anti")


def join_actuals(predictions: DataFrame, prices: DataFrame, date_col: str = "forecast_date",
                 keys=("market",), price_col: str = "modal_price") -> DataFrame:
    """Forecast rows with the observed price of the same market and day (left join on two
    keys; the price side is reduced to one row per key first)."""
    obs = (prices.groupBy(*keys, F.col("date").alias(date_col))
           .agg(F.max_by(price_col, "id").alias("observed_price")))
    return predictions.join(obs, [*keys, date_col], "left")


# ----------------------------------------------------------------------------- ordering

def top_recent(df: DataFrame, k: int = 10, col: str = "date", tie: str = "id") -> DataFrame:
    """Newest k rows (TakeOrderedAndProject: each task keeps k, the driver merges k x tasks)."""
    return df.orderBy(F.col(col).desc(), F.col(tie).desc()).limit(k)


def sort_by(df: DataFrame, *cols) -> DataFrame:
    return df.orderBy(*cols)


def extreme_row(df: DataFrame, col: str = "modal_price", highest: bool = True, tie: str = "id") -> DataFrame:
    o = F.col(col).desc() if highest else F.col(col).asc()
    return df.orderBy(o, F.col(tie).asc()).limit(1)


def paginate(df: DataFrame, order, page_size: int, page, total: int | None = None) -> DataFrame:
    """Page ``page`` (1-based, clamped to [1, last]) of ``page_size`` rows in ``order``.

    The page number is clamped with one count (a scalar).  A page beyond the first is a range of keys:
    rank selection (``ranks.keys_at``) finds its first and last key, and only rows in between are sorted, so the
    last page costs no more than any other.  ``order`` is names ("-name" descends) or plain, ``asc()`` or
    ``desc()`` columns, and should end in a unique column; rows with equal keys have no fixed place among
    themselves.  ``page_after`` (key-set paging) needs no count.
    """
    order = order_of(order)
    if total is None:
        total = df.count()
    last = max(1, math.ceil(total / page_size))
    try:
        p = int(page)
    except (TypeError, ValueError):
        p = 1
    p = min(max(p, 1), last)
    first, last = (p - 1) * page_size, min(p * page_size, total) - 1
    if not first:
        return df.orderBy(*sort_columns(order)).limit(page_size)
    low, high, skipped = keys_at(df, order, first, last, total)
    page_rows = df.filter(~before(order, low) & (before(order, high) | same(order, high))).orderBy(*sort_columns(order))
    return (page_rows.offset(first - skipped) if first > skipped else page_rows).limit(page_size)


def page_after(df: DataFrame, key_desc: tuple[str, str], after: tuple | None, page_size: int) -> DataFrame:
    """Key-set page: rows strictly after ``after`` in (key desc, tie desc) order."""
    k, t = key_desc
    out = df
    if after is not None:
        kv, tv = after
        out = df.filter((F.col(k) < F.lit(kv)) | ((F.col(k) == F.lit(kv)) & (F.col(t) < F.lit(tv))))
    return out.orderBy(F.col(k).desc(), F.col(t).desc()).limit(page_size)


def natural_key(col) -> Column:
    """Text sorted as a number when its digits parse (non-digits stripped)."""
    c = col if isinstance(col, Column) else F.col(col)
    return F.regexp_replace(c.cast("string"), r"[^0-9.\-]", "").try_cast("double")


def natural_sort(df: DataFrame, col: str, ascending: bool = True) -> DataFrame:
    k = natural_key(col)
    out = df.withColumn("natural_key", k)
    if ascending:
        return out.orderBy(F.col("natural_key").asc_nulls_last(), F.col(col).asc())
    return out.orderBy(F.col("natural_key").desc_nulls_last(), F.col(col).desc())


def chart_top15(predictions: DataFrame, k: int = 15, target: float = 85.0) -> DataFrame:
    """First k predictions (newest forecast first) as chart points: short label, accuracy, target."""
    top = top_recent(predictions, k, "forecast_date")
    return top.select("id", F.substring(F.col("market"), 1, 10).alias("label"),
                      F.coalesce(accuracy_value("predicted_modal_price", "actual_price"), F.lit(0.0)).alias("accuracy"),
                      F.lit(target).alias("target"))
