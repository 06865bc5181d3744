"""Registered queries: filters and predicates (survey 2.3) and projections (2.4)."""

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import selection as S
from ..operators.series import filter_min_history, lag_features, last_n_rows
from ..sources.canonical import table
from .registry import query
from .sqltext import AS_OF_PREDICTIONS, sround


def T(spark, sf, name):
    return table(spark, sf, name)


PRICE_COLS = "id, date, market, state, district, variety, min_price, max_price, modal_price, arrival_quantity"


@query("filter_contains", f"SELECT {PRICE_COLS} FROM prices WHERE contains(lower(market), 'plier#00000001')")
def q_filter_contains(spark, sf):
    return T(spark, sf, "prices").filter(P.contains("market", "PLIER#00000001"))


@query("filter_iexact", "SELECT * FROM predictions WHERE lower(market) = 'building'")
def q_filter_iexact(spark, sf):
    return T(spark, sf, "predictions").filter(P.iexact("market", "Building"))


@query("filter_exact", f"SELECT {PRICE_COLS} FROM prices WHERE market = 'Supplier#000000007'")
def q_filter_exact(spark, sf):
    return T(spark, sf, "prices").filter(P.exact("market", "Supplier#000000007"))


@query("filter_date_range", f"SELECT {PRICE_COLS} FROM prices WHERE date BETWEEN DATE '1996-01-01' AND DATE '1996-03-31'")
def q_filter_date_range(spark, sf):
    return T(spark, sf, "prices").filter(P.date_range("date", "1996-01-01", "1996-03-31"))


@query("filter_date_range_open", f"SELECT {PRICE_COLS} FROM prices WHERE date >= DATE '2001-06-01'")
def q_filter_date_range_open(spark, sf):
    # the end bound is unparseable text, so it is ignored
    return T(spark, sf, "prices").filter(P.date_range("date", "2001-06-01", "not-a-date"))


@query("filter_relative_range", f"""
SELECT * FROM predictions WHERE prediction_date >= CAST({AS_OF_PREDICTIONS} - INTERVAL 30 DAY AS DATE)""")
def q_filter_relative_range(spark, sf):
    p = T(spark, sf, "predictions")
    return p.filter(P.relative_range("prediction_date", "month", p.agg(F.max("forecast_date")).scalar()))


@query("filter_confidence", "SELECT * FROM predictions WHERE confidence_interval >= 60 AND confidence_interval < 80")
def q_filter_confidence(spark, sf):
    return T(spark, sf, "predictions").filter(P.confidence("confidence_interval", "medium"))


@query("filter_status", "SELECT * FROM predictions WHERE actual_price IS NOT NULL")
def q_filter_status(spark, sf):
    return T(spark, sf, "predictions").filter(P.status("actual_price", "verified"))


@query("filter_flags", "SELECT * FROM users WHERE is_staff")
def q_filter_flags(spark, sf):
    return T(spark, sf, "users").filter(P.flags("staff"))


@query("filter_active_factors", "SELECT * FROM factors WHERE is_active")
def q_filter_active_factors(spark, sf):
    return T(spark, sf, "factors").filter(F.col("is_active"))


@query("search_any", """
SELECT * FROM users WHERE coalesce(contains(lower(username), '00000012'), false)
   OR coalesce(contains(lower(email), '00000012'), false) OR coalesce(contains(lower(first_name), '00000012'), false)
   OR coalesce(contains(lower(last_name), '00000012'), false)""")
def q_search_any(spark, sf):
    return T(spark, sf, "users").filter(P.search_any(["username", "email", "first_name", "last_name"], "00000012"))


@query("search_messages", """
SELECT * FROM messages WHERE coalesce(contains(lower(name), 'src2'), false)
   OR coalesce(contains(lower(email), 'src2'), false) OR coalesce(contains(lower(subject), 'src2'), false)""")
def q_search_messages(spark, sf):
    return T(spark, sf, "messages").filter(P.search_any(["name", "email", "subject"], "src2"))


@query("search_terms", """
SELECT * FROM factors
WHERE (coalesce(contains(lower(name), 'red'), false) OR coalesce(contains(lower(description), 'red'), false))
  AND (coalesce(contains(lower(name), 'bolt'), false) OR coalesce(contains(lower(description), 'bolt'), false))""")
def q_search_terms(spark, sf):
    return T(spark, sf, "factors").filter(P.search_terms(["name", "description"], "Red  bolt"))


@query("facet_filter", f"SELECT {PRICE_COLS} FROM prices WHERE district = 'EUROPE' AND variety = 'ECONOMY'")
def q_facet_filter(spark, sf):
    return T(spark, sf, "prices").filter(P.facets({"district": "EUROPE", "variety": "ECONOMY", "state": ""}))


@query("filter_in", f"""
SELECT {PRICE_COLS} FROM prices WHERE id IN (SELECT id FROM prices WHERE arrival_quantity > 100)""")
def q_filter_in(spark, sf):
    p = T(spark, sf, "prices")
    return S.filter_in(p, "id", p.filter(F.col("arrival_quantity") > 100).select("id"))


@query("drop_incomplete", f"""
SELECT * FROM (SELECT {PRICE_COLS},
                      lag(modal_price, 1) OVER w AS price_lag_1, lag(modal_price, 7) OVER w AS price_lag_7
               FROM prices WINDOW w AS (PARTITION BY market ORDER BY date, id))
WHERE price_lag_1 IS NOT NULL AND price_lag_7 IS NOT NULL""")
def q_drop_incomplete(spark, sf):
    return S.drop_incomplete(lag_features(T(spark, sf, "prices"), (1, 7)))


@query("filter_min_history", f"""
SELECT {PRICE_COLS} FROM prices WHERE market IN (SELECT market FROM prices GROUP BY market HAVING count(*) >= 535)""")
def q_filter_min_history(spark, sf):
    return filter_min_history(T(spark, sf, "prices"), 535)


@query("last_n_rows", f"""
SELECT {PRICE_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY market ORDER BY date DESC, id DESC) AS rn FROM prices)
WHERE rn <= 365""")
def q_last_n_rows(spark, sf):
    return last_n_rows(T(spark, sf, "prices"), 365)


@query("filter_prices_combined", f"""
SELECT {PRICE_COLS} FROM prices WHERE contains(lower(market), '#00000002') AND contains(lower(state), 'nation_1')
  AND date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'""")
def q_filter_prices_combined(spark, sf):
    return S.filter_prices(T(spark, sf, "prices"), "#00000002", "contains", "NATION_1", "1997-01-01", "1998-12-31")


@query("filter_predictions_combined", """
SELECT * FROM predictions WHERE contains(lower(market), 'mach') AND forecast_date >= DATE '1996-01-01'
  AND confidence_interval >= 80""")
def q_filter_predictions_combined(spark, sf):
    return S.filter_predictions(T(spark, sf, "predictions"), "MACH", "contains", "1996-01-01", None, "high")


# ----------------------------------------------------------------------------- projections

@query("project_prices", "SELECT date, market, modal_price, min_price, max_price FROM prices")
def q_project_prices(spark, sf):
    return S.project_prices(T(spark, sf, "prices"))


@query("drop_columns", "SELECT id, date, market, state, variety, min_price, max_price, modal_price FROM prices")
def q_drop_columns(spark, sf):
    return S.drop_columns(T(spark, sf, "prices"), "district", "arrival_quantity")


@query("default_values", """
SELECT id, coalesce(nullif(actual_price, 0), 0.0) AS actual_price_or_zero,
       coalesce(nullif(CAST(model_used_id AS VARCHAR), ''), '-') AS model_or_dash,
       coalesce(nullif(market, ''), 'All Markets') AS market_or_all
FROM predictions""")
def q_default_values(spark, sf):
    from ..functions.scalars import default_value
    p = T(spark, sf, "predictions")
    return p.select("id", default_value("actual_price", 0.0).alias("actual_price_or_zero"),
                    default_value("model_used_id", "-").alias("model_or_dash"),
                    default_value("market", "All Markets").alias("market_or_all"))


_ACC_OK = "actual_price IS NOT NULL AND actual_price <> 0 AND predicted_modal_price <> 0"


@query("prediction_details", f"""
SELECT p.id, coalesce(nullif(p.market, ''), '-') AS market, strftime(p.forecast_date, '%Y-%m-%d') AS forecast_date,
       coalesce(p.predicted_min_price, 0.0) AS predicted_min_price,
       coalesce(p.predicted_modal_price, 0.0) AS predicted_modal_price,
       coalesce(p.predicted_max_price, 0.0) AS predicted_max_price,
       coalesce(p.confidence_interval, 0.0) AS confidence_interval,
       CASE WHEN p.actual_price <> 0 THEN p.actual_price END AS actual_price,
       coalesce(m.name, 'N/A') AS model_name, strftime(p.created_at, '%Y-%m-%dT%H:%M:%S') AS created_at,
       {sround(f"coalesce(CASE WHEN {_ACC_OK} THEN 100 - abs(p.predicted_modal_price - p.actual_price) / p.actual_price * 100 END, 0.0)", 8)} AS accuracy,
       {sround(f"CASE WHEN {_ACC_OK} THEN abs(p.predicted_modal_price - p.actual_price) ELSE 0.0 END", 8)} AS difference
FROM predictions p LEFT JOIN models m ON p.model_used_id = m.id""")
def q_prediction_details(spark, sf):
    d = S.prediction_details(T(spark, sf, "predictions"), T(spark, sf, "models")).select("prediction.*")
    return d.withColumn("model_name", F.col("model_used.name")).drop("model_used").withColumn("accuracy", F.round("accuracy", 8)).withColumn("difference", F.round("difference", 8))
