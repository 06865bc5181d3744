"""Registered queries: scalar functions (survey 2.10), each applied to a whole table."""

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators.forecast import price_trend
from ..sources.canonical import table
from .registry import query
from .sqltext import sround


def T(spark, sf, name):
    return table(spark, sf, name)


@query("date_parts", """
SELECT id, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, CAST(day(date) AS INTEGER) AS day, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week,
       CAST(dayofyear(date) AS INTEGER) AS day_of_year, CAST(weekofyear(date) AS INTEGER) AS week_of_year, CAST(quarter(date) AS INTEGER) AS quarter
FROM prices""")
def q_date_parts(spark, sf):
    p = T(spark, sf, "prices")
    return p.select("id", *[c.alias(n) for n, c in X.date_parts("date").items()])


@query("season", """
SELECT id, CAST(month(date) AS INTEGER) AS month,
       CASE WHEN month(date) BETWEEN 3 AND 5 THEN 0 WHEN month(date) BETWEEN 6 AND 9 THEN 1
            WHEN month(date) BETWEEN 10 AND 11 THEN 2 ELSE 3 END AS season
FROM prices""")
def q_season(spark, sf):
    p = T(spark, sf, "prices")
    return p.select("id", F.month("date").alias("month"), X.season(F.month("date")).alias("season"))


@query("format_dates", """
SELECT id, strftime(forecast_date, '%Y-%m-%d') AS iso_date, strftime(forecast_date, '%d %b %Y') AS display_date,
       strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created_iso
FROM predictions""")
def q_format_dates(spark, sf):
    p = T(spark, sf, "predictions")
    return p.select("id", X.format_date("forecast_date").alias("iso_date"),
                    X.format_date("forecast_date", "dd MMM yyyy").alias("display_date"),
                    X.format_date("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_iso"))


@query("accuracy_pct", f"""
SELECT id, coalesce({sround('(1 - abs(predicted_modal_price - actual_price) / nullif(actual_price, 0)) * 100', 2)}, 0.0)
         AS accuracy
FROM predictions""")
def q_accuracy_pct(spark, sf):
    p = T(spark, sf, "predictions")
    return p.select("id", X.accuracy_pct("predicted_modal_price", "actual_price").alias("accuracy"))


_ACC = ("CASE WHEN actual_price IS NOT NULL AND actual_price <> 0 AND predicted_modal_price <> 0 "
        "THEN 100 - abs(predicted_modal_price - actual_price) / actual_price * 100 END")


@query("accuracy_text", f"""
SELECT id, coalesce(printf('%.1f%%', {sround(_ACC, 1)}), '') AS accuracy_text FROM predictions""")
def q_accuracy_text(spark, sf):
    p = T(spark, sf, "predictions")
    return p.select("id", X.accuracy_text("predicted_modal_price", "actual_price").alias("accuracy_text"))


@query("price_difference", "SELECT id, abs(predicted_modal_price - actual_price) AS difference FROM predictions")
def q_price_difference(spark, sf):
    p = T(spark, sf, "predictions")
    return p.select("id", X.price_difference("predicted_modal_price", "actual_price").alias("difference"))


@query("accuracy_grade", f"""
SELECT id, CASE WHEN a IS NULL THEN 'Pending' WHEN a > 90 THEN 'Excellent' WHEN a > 80 THEN 'Good'
                WHEN a > 70 THEN 'Fair' ELSE 'Poor' END AS grade
FROM (SELECT id, {_ACC} AS a FROM predictions)""")
def q_accuracy_grade(spark, sf):
    p = T(spark, sf, "predictions")
    return p.select("id", X.accuracy_grade(X.accuracy_value("predicted_modal_price", "actual_price")).alias("grade"))


@query("accuracy_band", f"""
SELECT id, CASE WHEN a IS NULL THEN 'bg-secondary' WHEN a > 80 THEN 'bg-success' WHEN a > 70 THEN 'bg-warning'
                ELSE 'bg-danger' END AS band,
       CASE WHEN a IS NULL THEN NULL WHEN {sround('a', 1)} >= 90 THEN 'green' WHEN {sround('a', 1)} >= 75 THEN 'amber'
            ELSE 'red' END AS color
FROM (SELECT id, {_ACC} AS a FROM predictions)""")
def q_accuracy_band(spark, sf):
    p = T(spark, sf, "predictions")
    a = X.accuracy_value("predicted_modal_price", "actual_price")
    return p.select("id", X.accuracy_band(a).alias("band"), X.accuracy_color(a).alias("color"))


@query("confidence_band", """
SELECT id, CASE WHEN confidence_interval IS NULL THEN '' WHEN confidence_interval >= 80 THEN 'confidence-high'
                WHEN confidence_interval >= 60 THEN 'confidence-medium' ELSE 'confidence-low' END AS confidence_class
FROM predictions""")
def q_confidence_band(spark, sf):
    p = T(spark, sf, "predictions")
    return p.select("id", X.confidence_band("confidence_interval").alias("confidence_class"))


@query("price_band", """
SELECT id, CASE WHEN modal_price > 950 THEN 'price-high' WHEN modal_price > 925 THEN 'price-medium' ELSE 'price-low' END
         AS price_class,
       CASE WHEN modal_price / 100 > 50 THEN 'price-high' WHEN modal_price / 100 > 30 THEN 'price-medium' ELSE 'price-low' END
         AS price_class_per_kg
FROM prices""")
def q_price_band(spark, sf):
    p = T(spark, sf, "prices")
    return p.select("id", X.price_band("modal_price", 950, 925).alias("price_class"),
                    X.price_band(F.col("modal_price") / 100).alias("price_class_per_kg"))


@query("impact_direction", "SELECT id, CASE WHEN impact_score - 50 > 0 THEN 'up' ELSE 'down' END AS direction FROM factors")
def q_impact_direction(spark, sf):
    f = T(spark, sf, "factors")
    return f.select("id", X.impact_direction(F.col("impact_score") - 50).alias("direction"))


@query("safe_arith", """
SELECT id,
       coalesce(actual_price - predicted_modal_price, actual_price) AS diff,
       coalesce(confidence_interval * TRY_CAST(CASE WHEN id % 3 = 0 THEN 'x' ELSE '2' END AS DOUBLE), confidence_interval)
         AS doubled,
       coalesce(CASE WHEN confidence_interval - 50 <> 0 THEN predicted_modal_price / (confidence_interval - 50) END, 0.0)
         AS per_point,
       coalesce(CAST(abs(TRY_CAST(market AS DOUBLE)) AS VARCHAR), market) AS abs_text,
       coalesce(CAST(TRY_CAST(market AS DOUBLE) - id AS VARCHAR), market) AS less_text,
       coalesce(CAST(TRY_CAST(t AS DOUBLE) * 2 AS VARCHAR), t) AS twice_text, abs(actual_price - predicted_modal_price) AS abs_diff
FROM (SELECT *, CASE WHEN id % 3 = 0 THEN 'n/a' ELSE CAST(id % 1000 AS VARCHAR) END AS t FROM predictions)""")
def q_safe_arith(spark, sf):
    p = T(spark, sf, "predictions")
    return p.select("id", X.safe_subtract("actual_price", "predicted_modal_price").alias("diff"),
                    X.safe_multiply("confidence_interval",
                                    F.when(F.col("id") % 3 == 0, F.lit("x")).otherwise(F.lit("2"))).alias("doubled"),
                    X.safe_divide("predicted_modal_price", F.col("confidence_interval") - 50).alias("per_point"),
                    X.safe_abs("market", keep_text=True).alias("abs_text"), X.safe_subtract("market", "id", keep_text=True).alias("less_text"),
                    X.safe_multiply(F.when(F.col("id") % 3 == 0, "n/a").otherwise((F.col("id") % 1000).cast("string")), F.lit(2), keep_text=True).alias("twice_text"),
                    X.safe_abs(F.col("actual_price") - F.col("predicted_modal_price")).alias("abs_diff"))


@query("format_price", f"""
SELECT id, '₹' || printf('%.2f', {sround('predicted_modal_price', 2)}) AS price_text,
       market AS market_text
FROM predictions""")
def q_format_price(spark, sf):
    p = T(spark, sf, "predictions")
    return p.select("id", X.format_price("predicted_modal_price").alias("price_text"),
                    X.format_price("market").alias("market_text"))


@query("format_price_lakh", f"""
WITH t AS (SELECT id, v < 0 AS minus, printf('%.3f', abs(v)) AS s FROM (SELECT id, {sround('predicted_modal_price * 100 - 30000.5', 3)} AS v FROM predictions)),
x AS (SELECT id, minus, split_part(s, '.', 1) AS w, rtrim(split_part(s, '.', 2), '0') AS f FROM t)
SELECT id, CASE WHEN minus THEN '-' ELSE '' END
           || CASE WHEN length(w) <= 3 THEN w ELSE ltrim(reverse(regexp_replace(reverse(left(w, length(w) - 3)), '(..)', '\\1,', 'g')), ',') || ',' || right(w, 3) END
           || CASE WHEN f <> '' THEN '.' || f ELSE '' END AS lakh_text
FROM x""")
def q_format_price_lakh(spark, sf):
    p = T(spark, sf, "predictions")
    return p.select("id", X.format_price_lakh(F.col("predicted_modal_price") * 100 - 30000.5).alias("lakh_text"))


@query("truncate_text", """
SELECT id, CASE WHEN length(message) > 50 THEN substr(message, 1, 49) || '…' ELSE message END AS preview,
       substr(CAST(created_at AS VARCHAR), 1, 10) AS created_day
FROM messages""")
def q_truncate_text(spark, sf):
    m = T(spark, sf, "messages")
    return m.select("id", X.truncate_text("message", 50).alias("preview"),
                    F.substring(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"), 1, 10).alias("created_day"))


@query("clip", "SELECT id, greatest(least(predicted_modal_price, 200000.0), 1000.0) AS clipped FROM predictions")
def q_clip(spark, sf):
    p = T(spark, sf, "predictions")
    return p.select("id", X.clip("predicted_modal_price", 1000.0, 200000.0).alias("clipped"))


@query("json_preferences", """
SELECT user_id, json_extract_string(preferences, '$.k') AS pref_k,
       CAST(len(json_keys(preferences)) AS INTEGER) AS n_keys
FROM profiles""")
def q_json_preferences(spark, sf):
    p = T(spark, sf, "profiles")
    m = X.json_to_map("preferences")
    return p.select("user_id", m["k"].alias("pref_k"), F.size(m).alias("n_keys"))


@query("json_preferences_roundtrip", """
SELECT user_id, '{' || coalesce((SELECT string_agg('"' || k || '":"' || json_extract_string(preferences, '$."' || k || '"') || '"', ',')
                                 FROM (SELECT unnest(json_keys(preferences)) AS k)), '') || '}' AS preferences FROM profiles""")
def q_json_preferences_roundtrip(spark, sf):
    # map -> text -> map round trip (text formatting differs between engines: rows only)
    p = T(spark, sf, "profiles")
    return p.select("user_id", X.map_to_json(X.json_to_map("preferences")).alias("preferences"))


@query("trend_label", f"""
WITH t AS (SELECT market, modal_price, row_number() OVER (PARTITION BY market ORDER BY date DESC, id DESC) AS rn FROM prices),
g AS (SELECT market, max(CASE WHEN rn = 1 THEN modal_price END) AS c, max(CASE WHEN rn = 2 THEN modal_price END) AS p
      FROM t WHERE rn <= 2 GROUP BY market),
x AS (SELECT market, coalesce((c - p) / p * 100, 0) AS ch FROM g)
SELECT market, CASE WHEN ch > 2 THEN 'Rising' WHEN ch < -2 THEN 'Falling' ELSE 'Stable' END AS trend_label FROM x""")
def q_trend_label(spark, sf):
    t = price_trend(T(spark, sf, "prices"), rows=2)
    return t.select("market", X.trend_label("trend").alias("trend_label"))
