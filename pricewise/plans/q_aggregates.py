"""Registered queries: aggregations (survey 2.6)."""

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators.series import naive_baseline, series_window
from ..sources.canonical import table
from .registry import query
from .sqltext import AS_OF_PREDICTIONS, AS_OF_PRICES, mean, sround

MEAN = mean("modal_price")


def T(spark, sf, name):
    return table(spark, sf, name)


@query("dashboard_totals", f"""
SELECT count(*) AS total_prices,
       (SELECT count(*) FROM predictions) AS total_predictions,
       (SELECT count(*) FROM users) AS total_users,
       coalesce({MEAN}, 0.0) AS avg_price
FROM prices""")
def q_dashboard_totals(spark, sf):
    return A.dashboard_totals(T(spark, sf, "prices"), T(spark, sf, "predictions"), T(spark, sf, "users"))


@query("price_stats", f"""
SELECT count(*) AS total_records, coalesce({MEAN}, 0.0) AS avg_price,
       arg_max(id, (modal_price, -id)) AS highest_id, arg_max(date, (modal_price, -id)) AS highest_date,
       arg_max(market, (modal_price, -id)) AS highest_market, max(modal_price) AS highest_modal_price,
       arg_min(id, (modal_price, id)) AS lowest_id, arg_min(date, (modal_price, id)) AS lowest_date,
       arg_min(market, (modal_price, id)) AS lowest_market, min(modal_price) AS lowest_modal_price
FROM prices""")
def q_price_stats(spark, sf):
    return A.price_stats(T(spark, sf, "prices"))


@query("price_change_pct", f"""
WITH a AS (SELECT {AS_OF_PRICES} AS e),
w AS (SELECT modal_price, date BETWEEN CAST(e - INTERVAL 30 DAY AS DATE) AND CAST(e - INTERVAL 29 DAY AS DATE) AS in_s,
             date BETWEEN CAST(e - INTERVAL 1 DAY AS DATE) AND e AS in_e FROM prices, a),
g AS (SELECT {mean("CASE WHEN in_s THEN modal_price END")} AS s_avg,
             {mean("CASE WHEN in_e THEN modal_price END")} AS e_avg
      FROM w)
SELECT coalesce(s_avg, 0) AS start_avg, coalesce(e_avg, 0) AS end_avg,
       CASE WHEN coalesce(s_avg, 0) > 0 THEN {sround('(coalesce(e_avg, 0) - s_avg) / s_avg * 100', 2)} ELSE 0.0 END
         AS price_change_pct
FROM g""")
def q_price_change_pct(spark, sf):
    p = T(spark, sf, "prices")
    e = p.agg(F.max("date")).scalar()
    return A.price_change_pct(p, F.date_sub(e, 30), e)


@query("prediction_stats", f"""
SELECT count(*) AS total_predictions, {sround('coalesce(avg(confidence_interval), 0)', 4)} AS avg_confidence,
       count(*) FILTER (WHERE confidence_interval >= 80) AS high_confidence_predictions,
       count(*) FILTER (WHERE forecast_date >= CAST({AS_OF_PREDICTIONS} - INTERVAL 7 DAY AS DATE)) AS predictions_last_7_days
FROM predictions""")
def q_prediction_stats(spark, sf):
    return A.prediction_stats(T(spark, sf, "predictions")).withColumn("avg_confidence", F.round("avg_confidence", 4))


@query("predictions_per_day", f"""
SELECT {sround(f"count(*) FILTER (WHERE forecast_date >= CAST({AS_OF_PREDICTIONS} - INTERVAL 7 DAY AS DATE)) / 7", 1)}
       AS predictions_per_day
FROM predictions""")
def q_predictions_per_day(spark, sf):
    return A.predictions_per_day(T(spark, sf, "predictions"))


@query("confidence_distribution", """
SELECT CASE WHEN confidence_interval >= 80 THEN 'high' WHEN confidence_interval >= 60 THEN 'medium' ELSE 'low' END
         AS confidence_level, count(*) AS predictions
FROM predictions GROUP BY 1""")
def q_confidence_distribution(spark, sf):
    return A.confidence_distribution(T(spark, sf, "predictions"))


_ACC = "100 - abs(predicted_modal_price - actual_price) / actual_price * 100"
_ACC_OK = "actual_price IS NOT NULL AND actual_price <> 0 AND predicted_modal_price <> 0"


@query("avg_accuracy", f"""
SELECT coalesce({sround(f'avg(CASE WHEN {_ACC_OK} THEN {_ACC} END)', 1)}, 0.0) AS avg_accuracy,
       count(CASE WHEN {_ACC_OK} THEN 1 END) AS scored_predictions
FROM predictions""")
def q_avg_accuracy(spark, sf):
    return A.avg_accuracy(T(spark, sf, "predictions"))


@query("verification_stats", f"""
SELECT count(actual_price) AS verified, count(*) FILTER (WHERE actual_price IS NULL) AS pending,
       count(*) AS total, {sround('coalesce(avg(confidence_interval), 0)', 1)} AS avg_confidence
FROM predictions""")
def q_verification_stats(spark, sf):
    return A.verification_stats(T(spark, sf, "predictions"))


@query("user_stats", """
WITH a AS (SELECT CAST(max(last_login) AS DATE) AS d FROM users)
SELECT count(*) AS total_users,
       count(*) FILTER (WHERE CAST(last_login AS DATE) >= CAST(d - INTERVAL 30 DAY AS DATE)) AS active_users,
       count(*) FILTER (WHERE CAST(date_joined AS DATE) = d) AS new_users_today,
       count(*) FILTER (WHERE CAST(date_joined AS DATE) >= CAST(d - INTERVAL 7 DAY AS DATE)) AS new_users_week
FROM users, a""")
def q_user_stats(spark, sf):
    return A.user_stats(T(spark, sf, "users"))


@query("factor_stats", f"""
SELECT count(*) AS total_factors, count(*) FILTER (WHERE is_active) AS active_count,
       CASE WHEN count(*) > 0 THEN {sround('count(*) FILTER (WHERE is_active) / count(*) * 100', 1)} ELSE 0.0 END
         AS active_percentage,
       {sround('coalesce(avg(impact_score), 0)', 1)} AS avg_impact_score,
       count(*) FILTER (WHERE impact_score >= 70) AS high_impact_count
FROM factors""")
def q_factor_stats(spark, sf):
    return A.factor_stats(T(spark, sf, "factors"))


@query("message_stats", """
SELECT count(*) AS total_count, count(*) FILTER (WHERE subscribed_to_alerts) AS alert_subscribers
FROM messages
WHERE coalesce(contains(lower(name), 'src1'), false) OR coalesce(contains(lower(email), 'src1'), false)
   OR coalesce(contains(lower(subject), 'src1'), false)""")
def q_message_stats(spark, sf):
    return A.message_stats(T(spark, sf, "messages"), "src1")


@query("facet_values_market", "SELECT DISTINCT market FROM prices")
def q_facet_values_market(spark, sf):
    return A.facet_values(T(spark, sf, "prices"), "market")


@query("facet_values_factor_type", "SELECT DISTINCT factor_type FROM factors WHERE factor_type IS NOT NULL AND factor_type <> ''")
def q_facet_values_factor_type(spark, sf):
    return A.facet_values(T(spark, sf, "factors"), "factor_type", drop_empty=True)


@query("profile_numeric", f"""
SELECT min(modal_price) AS min, max(modal_price) AS max, {MEAN} AS mean,
       {sround('quantile_cont(modal_price, 0.5)', 6)} AS median, {sround('stddev_samp(modal_price)', 4)} AS std
FROM prices""")
def q_profile_numeric(spark, sf):
    return A.profile_numeric(T(spark, sf, "prices")).select(
        "min", "max", "mean", F.round("median", 6).alias("median"),
        F.round("std", 4).alias("std"))


@query("profile_cardinality", "SELECT count(DISTINCT market) AS unique_market, count(DISTINCT state) AS unique_state FROM prices")
def q_profile_cardinality(spark, sf):
    return A.profile_cardinality(T(spark, sf, "prices"))


@query("profile_missing", """
SELECT * FROM (
  SELECT 'model_used_id' AS "column", count(*) FILTER (WHERE model_used_id IS NULL) AS missing FROM predictions
  UNION ALL SELECT 'actual_price', count(*) FILTER (WHERE actual_price IS NULL) FROM predictions
  UNION ALL SELECT 'id', count(*) FILTER (WHERE id IS NULL) FROM predictions
  UNION ALL SELECT 'market', count(*) FILTER (WHERE market IS NULL) FROM predictions
  UNION ALL SELECT 'forecast_date', count(*) FILTER (WHERE forecast_date IS NULL) FROM predictions
) WHERE missing > 0""")
def q_profile_missing(spark, sf):
    return A.profile_missing(T(spark, sf, "predictions"))


@query("profile_date_span", """
SELECT min(date) AS first_date, max(date) AS last_date, CAST(date_diff('day', min(date), max(date)) AS INTEGER) AS total_days
FROM prices""")
def q_profile_date_span(spark, sf):
    return A.profile_date_span(T(spark, sf, "prices"))


@query("avg_price_by_market", f"""
SELECT market, {MEAN} AS avg_price, count(*) AS n FROM prices GROUP BY market""")
def q_avg_price_by_market(spark, sf):
    return A.avg_price_by_market(T(spark, sf, "prices"))


@query("low_cardinality_check", """
SELECT * FROM (VALUES ('market', (SELECT count(DISTINCT market) FROM prices)),
                      ('state', (SELECT count(DISTINCT state) FROM prices)),
                      ('variety', (SELECT count(DISTINCT variety) FROM prices))) t("column", distinct_values)
""".replace("SELECT * FROM", "SELECT \"column\", distinct_values, distinct_values < 20 AS below_limit FROM"))
def q_low_cardinality_check(spark, sf):
    return A.low_cardinality_check(T(spark, sf, "prices"))


# Metrics of three simple predictors per market, so the R^2 spread is real.
_PRED_SQL = """
p AS (SELECT market, modal_price,
             lag(modal_price, 1) OVER w AS naive,
             lag(modal_price, 7) OVER w AS weekly,
             avg(modal_price) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS ma7
      FROM prices WINDOW w AS (PARTITION BY market ORDER BY date, id))"""


def _predictors(spark, sf):
    p = T(spark, sf, "prices")
    w = series_window()
    return p.select("market", "modal_price",
                    F.lag("modal_price", 1).over(w).alias("naive"),
                    F.lag("modal_price", 7).over(w).alias("weekly"),
                    F.avg("modal_price").over(w.rowsBetween(-7, -1)).alias("ma7"))


@query("regression_metrics", f"""
WITH {_PRED_SQL}
SELECT market, {sround('avg((modal_price - naive) ^ 2)', 4)} AS mse, {sround('avg(abs(modal_price - naive))', 4)} AS mae,
       {sround('1 - sum((modal_price - naive) ^ 2) / (count(*) * var_pop(modal_price))', 6)} AS r2,
       {sround('avg(modal_price)', 4)} AS mean_actual, {sround('avg(naive)', 4)} AS mean_predicted, count(*) AS n
FROM p WHERE naive IS NOT NULL GROUP BY market""")
def q_regression_metrics(spark, sf):
    m = A.regression_metrics(naive_baseline(T(spark, sf, "prices")), by=["market"])
    return m.select("market", *[F.round(c, d).alias(c) for c, d in
                                (("mse", 4), ("mae", 4), ("r2", 6), ("mean_actual", 4), ("mean_predicted", 4))], "n")


@query("select_best_model", f"""
WITH {_PRED_SQL},
m AS (SELECT 'naive' AS model, 1 - sum((modal_price - naive) ^ 2) / (count(*) * var_pop(modal_price)) AS r2
      FROM p WHERE naive IS NOT NULL
      UNION ALL SELECT 'weekly', 1 - sum((modal_price - weekly) ^ 2) / (count(*) * var_pop(modal_price))
      FROM p WHERE weekly IS NOT NULL
      UNION ALL SELECT 'ma7', 1 - sum((modal_price - ma7) ^ 2) / (count(*) * var_pop(modal_price))
      FROM p WHERE ma7 IS NOT NULL)
SELECT arg_min(model, (-r2, model)) AS best_model, {sround('max(r2)', 6)} AS best_r2, bool_and(r2 < 0) AS all_negative,
       CASE WHEN bool_and(r2 < 0) THEN 'all negative' WHEN max(r2) > 0.5 THEN 'good' WHEN max(r2) > 0 THEN 'weak'
            ELSE 'none positive' END AS verdict
FROM m""")
def q_select_best_model(spark, sf):
    m = A.metrics_by_column(_predictors(spark, sf), ("naive", "weekly", "ma7"))
    return A.select_best_model(m).withColumn("best_r2", F.round("best_r2", 6))


@query("facet_values", "SELECT DISTINCT market FROM predictions")
def q_facet_values(spark, sf):
    return A.facet_values(T(spark, sf, "predictions"), "market")
