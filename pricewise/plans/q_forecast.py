"""Registered queries: forecast, trend, advice (survey 2.12)."""

from pyspark.sql import functions as F

from ..operators import forecast as fc
from ..operators.series import load_recent_window
from ..sources.canonical import table
from .registry import query
from .sqltext import AS_OF_PRICES, mean, sround, trend_case


def _prices(spark, sf):
    return table(spark, sf, "prices")


TAIL_CTE = """
t AS (SELECT market, date, id, modal_price,
             row_number() OVER (PARTITION BY market ORDER BY date DESC, id DESC) AS rn
      FROM prices)"""


@query("price_trend", f"""
WITH {TAIL_CTE},
g AS (SELECT market,
             max(CASE WHEN rn = 1 THEN modal_price END) AS current_price,
             max(CASE WHEN rn = 2 THEN modal_price END) AS prev,
             min(modal_price) AS min_30d, max(modal_price) AS max_30d,
             {mean("modal_price")} AS avg_30d
      FROM t WHERE rn <= 30 GROUP BY market),
c AS (SELECT *, (current_price - prev) / prev * 100 AS ch FROM g)
SELECT market, current_price, {trend_case('coalesce(ch, 0)')} AS trend, min_30d, max_30d,
       avg_30d, coalesce({sround('ch', 2)}, 0.0) AS daily_change
FROM c""")
def q_price_trend(spark, sf):
    return fc.price_trend(_prices(spark, sf))


def forecast_sql(as_of_expr: str = AS_OF_PRICES, horizon: int = 7, bands: bool = False) -> str:
    """DuckDB text of the forecast: the recursion unrolled into one CTE per step."""
    ctes = [f"""a AS (SELECT {as_of_expr} AS as_of)""",
            """h AS (SELECT p.* FROM prices p, a WHERE p.date >= CAST(a.as_of - INTERVAL 730 DAY AS DATE) AND p.date <= a.as_of)""",
            """ft AS (SELECT market, modal_price, row_number() OVER (PARTITION BY market ORDER BY date DESC, id DESC) AS rn FROM h)""",
            f"""fs AS (SELECT market, count(*) AS n, {mean("modal_price")} AS mu FROM h GROUP BY market)""",
            f"""fk AS (SELECT market, max(CASE WHEN rn = 1 THEN modal_price END) AS p1,
                       max(CASE WHEN rn = 7 THEN modal_price END) AS p7,
                       {mean("CASE WHEN rn <= 7 THEN modal_price END")} AS m7
                FROM ft WHERE rn <= 8 GROUP BY market)""",
            f"""c0 AS (SELECT fs.market, {sround('m7', 2)} AS q0,
                       coalesce((p1 - p7) / p7, 0) AS tr,
                       greatest(mu * 0.7, 500) AS lo, mu * 1.3 AS hi
                FROM fs JOIN fk ON fs.market = fk.market WHERE fs.n >= 7)"""]
    for i in range(1, horizon):
        ctes.append(f"c{i} AS (SELECT *, {sround(f'greatest(least(q{i - 1} * (1.0 + tr * pow(0.8, {i})), hi), lo)', 2)}"
                    f" AS q{i} FROM c{i - 1})")
    last = f"c{horizon - 1}"
    rows = " UNION ALL ".join(
        f"SELECT market, {i} AS step, q{i} AS predicted_price, q0 AS initial_price, tr AS trend, lo AS lower_bound, "
        f"hi AS upper_bound FROM {last}" for i in range(horizon))
    ctes.append(f"fc AS (SELECT x.*, CAST(a.as_of + (x.step + 1) AS DATE) AS date FROM ({rows}) x, a)")
    if bands:
        ctes.append(f"""fb AS (SELECT *, {sround('predicted_price * 0.95', 2)} AS min_price,
                        {sround('predicted_price * 1.05', 2)} AS max_price, {sround('0.85 - 0.05 * step', 2)} AS confidence
                        FROM fc)""")
    return "WITH " + ",\n".join(ctes) + "\n"


@query("latest_feature_row", f"""
WITH h AS (SELECT * FROM prices WHERE date >= CAST({AS_OF_PRICES} - INTERVAL 730 DAY AS DATE)),
t AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY date DESC, id DESC) AS rn FROM h),
s AS (SELECT market, count(*) AS n, {mean("modal_price")} AS mu FROM h GROUP BY market),
k AS (SELECT market, max(CASE WHEN rn = 1 THEN modal_price END) AS p1, max(CASE WHEN rn = 2 THEN modal_price END) AS p2,
             max(CASE WHEN rn = 8 THEN modal_price END) AS p8, max(CASE WHEN rn = 1 THEN date END) AS d,
             {mean("CASE WHEN rn <= 7 THEN modal_price END")} AS m7, {mean("modal_price")} AS m30
      FROM t WHERE rn <= 30 GROUP BY market)
SELECT s.market, d AS date, p1 AS modal_price, CAST(dayofyear(d) AS INTEGER) AS day_of_year, CAST(month(d) AS INTEGER) AS month, CAST(year(d) AS INTEGER) AS year,
       CASE WHEN n >= 2 THEN p2 ELSE p1 END AS price_lag_1, CASE WHEN n >= 8 THEN p8 ELSE p1 END AS price_lag_7,
       CASE WHEN n >= 7 THEN m7 ELSE mu END AS price_ma_7,
       CASE WHEN n >= 30 THEN m30 ELSE mu END AS price_ma_30,
       {sround('CASE WHEN n >= 2 THEN (p1 - p2) / p2 ELSE 0.0 END', 10)} AS price_change_1,
       {sround('CASE WHEN n >= 8 THEN (p1 - p8) / p8 ELSE 0.0 END', 10)} AS price_change_7, n AS n_rows
FROM s JOIN k ON s.market = k.market WHERE n >= 7""")
def q_latest_feature_row(spark, sf):
    p = _prices(spark, sf)
    h = load_recent_window(p)
    return fc.latest_feature_row(h).select(
        "market", "date", "modal_price", "day_of_year", "month", "year", "price_lag_1", "price_lag_7",
        "price_ma_7", "price_ma_30", F.round("price_change_1", 10).alias("price_change_1"),
        F.round("price_change_7", 10).alias("price_change_7"), "n_rows")


@query("initial_prediction", forecast_sql() + "SELECT market, q0 AS initial_price FROM c0")
def q_initial_prediction(spark, sf):
    h = load_recent_window(_prices(spark, sf))
    return fc.initial_prediction(fc.latest_feature_row(h)).select("market", "initial_price")


@query("forecast_7d", forecast_sql() + """
SELECT market, step, date, predicted_price, initial_price, trend, lower_bound, upper_bound FROM fc""")
def q_forecast_7d(spark, sf):
    return fc.forecast_7d(_prices(spark, sf)).select(
        "market", "step", "date", "predicted_price", "initial_price", "trend", "lower_bound", "upper_bound")


@query("forecast_bands", forecast_sql(bands=True) + """
SELECT market, step, date, predicted_price, min_price, max_price, confidence FROM fb""")
def q_forecast_bands(spark, sf):
    return fc.forecast_bands(fc.forecast_7d(_prices(spark, sf))).select(
        "market", "step", "date", "predicted_price", "min_price", "max_price", "confidence")


@query("forecast_backtest", forecast_sql("(SELECT CAST(max(date) - INTERVAL 7 DAY AS DATE) FROM prices)") + """
SELECT fc.market, fc.date, fc.predicted_price, o.observed_price
FROM fc LEFT JOIN (SELECT market, date, arg_max(modal_price, id) AS observed_price FROM prices GROUP BY market, date) o
  ON fc.market = o.market AND fc.date = o.date""")
def q_forecast_backtest(spark, sf):
    # join_actuals: a forecast made 7 days before the last date, against what was observed
    from ..operators.selection import join_actuals
    p = _prices(spark, sf)
    a = F.date_sub(p.agg(F.max("date")).scalar(), 7)
    f = fc.forecast_7d(p, a).select("market", "date", "predicted_price")
    return join_actuals(f, p, "date").select("market", "date", "predicted_price", "observed_price")


def _rules_sql() -> str:
    vals = ",\n".join("(" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in r) + ")"
                      for r in fc.ADVICE_RULES)
    return f"rules AS (SELECT * FROM (VALUES {vals}) r(user_type, direction, type, message, confidence, action))"


_TREND_SQL = f"""
tt AS (SELECT market, modal_price, row_number() OVER (PARTITION BY market ORDER BY date DESC, id DESC) AS rn FROM h),
tg AS (SELECT market, max(CASE WHEN rn = 1 THEN modal_price END) AS current_price,
              max(CASE WHEN rn = 2 THEN modal_price END) AS prev FROM tt WHERE rn <= 2 GROUP BY market),
tr AS (SELECT market, current_price, {trend_case('coalesce((current_price - prev) / prev * 100, 0)')} AS trend FROM tg),
td AS (SELECT *, CASE WHEN trend IN ('Increasing', 'Increasing Rapidly') THEN 'up'
                      WHEN trend IN ('Decreasing', 'Decreasing Rapidly') THEN 'down' ELSE 'flat' END AS direction FROM tr)"""


@query("recommend", forecast_sql() + "," + _rules_sql() + "," + _TREND_SQL + f""",
fa AS (SELECT market, {mean("predicted_price")} AS avg_predicted
       FROM fc GROUP BY market)
SELECT td.market, rules.user_type, td.trend, rules.type, rules.message, rules.confidence, rules.action, 0 AS rule_order
FROM td JOIN rules ON td.direction = rules.direction
UNION ALL
SELECT td.market, 'FARMER', td.trend, 'DELAY_SELL', printf('Prices expected to rise to ₹%.2f in next week', fa.avg_predicted),
       'Medium', 'Consider waiting 3-4 days', 1
FROM td JOIN fa ON td.market = fa.market WHERE fa.avg_predicted > td.current_price * 1.05""")
def q_recommend(spark, sf):
    p = _prices(spark, sf)
    s = fc.market_summary(p)
    return fc.recommend(fc.trend_from_summary(s), fc.forecast_from_summary(s, p.agg(F.max("date")).scalar()))


@query("market_analysis", forecast_sql(bands=True) + "," + _TREND_SQL.replace("tt AS", "tt0 AS", 0) + f""",
mt AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY date DESC, id DESC) AS rn FROM h),
ms AS (SELECT market, count(*) AS n, arg_max(state, (date, id)) AS state, arg_max(district, (date, id)) AS district,
              arg_max(variety, (date, id)) AS variety, max(date) AS last_date FROM h GROUP BY market),
mk AS (SELECT market, max(CASE WHEN rn = 1 THEN modal_price END) AS p1, max(CASE WHEN rn = 7 THEN modal_price END) AS p7,
              min(CASE WHEN rn <= 7 THEN modal_price END) AS min_7d, max(CASE WHEN rn <= 7 THEN modal_price END) AS max_7d,
              {mean("CASE WHEN rn <= 7 THEN modal_price END")} AS avg_7d,
              {mean("modal_price")} AS avg_30d,
              min(modal_price) AS min_30d, max(modal_price) AS max_30d,
              max(CASE WHEN rn = 2 THEN modal_price END) AS p2
       FROM mt WHERE rn <= 30 GROUP BY market),
mf AS (SELECT market, count(*) AS n_predictions, max(CASE WHEN step = 6 THEN predicted_price END) AS last_predicted_price
       FROM fb GROUP BY market)
SELECT ms.market,
       CASE WHEN n >= 7 THEN p1 END AS current_price, CASE WHEN n >= 7 THEN strftime(last_date, '%Y-%m-%d') END AS current_date,
       CASE WHEN n >= 7 THEN ms.state END AS state, CASE WHEN n >= 7 THEN ms.district END AS district,
       CASE WHEN n >= 7 THEN ms.variety END AS variety,
       CASE WHEN n >= 7 THEN min_7d END AS min_7d, CASE WHEN n >= 7 THEN max_7d END AS max_7d,
       CASE WHEN n >= 7 THEN avg_7d END AS avg_7d,
       CASE WHEN n >= 7 THEN {sround('(p1 - p7) / p7 * 100', 2)} END AS weekly_change,
       CASE WHEN n >= 7 THEN {trend_case('coalesce((p1 - p2) / p2 * 100, 0)')} END AS trend,
       CASE WHEN n >= 7 THEN coalesce({sround('(p1 - p2) / p2 * 100', 2)}, 0.0) END AS daily_change,
       CASE WHEN n >= 7 THEN avg_30d END AS avg_30d,
       mf.n_predictions, mf.last_predicted_price,
       CASE WHEN n < 7 THEN 'Insufficient data for ' || ms.market END AS error
FROM ms JOIN mk ON ms.market = mk.market LEFT JOIN mf ON ms.market = mf.market""")
def q_market_analysis(spark, sf):
    m = fc.market_analysis(_prices(spark, sf))
    return m.select("market", "current_price", "current_date", "state", "district", "variety",
                    "price_stats.min_7d", "price_stats.max_7d", "price_stats.avg_7d", "weekly_change",
                    F.col("trend.trend").alias("trend"), F.col("trend.daily_change").alias("daily_change"),
                    F.col("trend.avg_30d").alias("avg_30d"),
                    F.when(F.col("predictions").isNotNull(), F.size("predictions")).cast("bigint").alias("n_predictions"),
                    F.element_at("predictions", -1)["predicted_price"].alias("last_predicted_price"), "error")


_BACKTEST_AS_OF = "(SELECT CAST(max(date) - INTERVAL 7 DAY AS DATE) FROM prices)"


@query("join_actuals", forecast_sql(_BACKTEST_AS_OF) + """
SELECT fc.market, fc.date AS forecast_date, fc.predicted_price, o.observed_price
FROM fc LEFT JOIN (SELECT market, date, arg_max(modal_price, id) AS observed_price FROM prices GROUP BY market, date) o
  ON fc.market = o.market AND fc.date = o.date""")
def q_join_actuals(spark, sf):
    from ..operators.selection import join_actuals
    p = _prices(spark, sf)
    a = F.date_sub(p.agg(F.max("date")).scalar(), 7)
    f = fc.forecast_7d(p, a).select("market", F.col("date").alias("forecast_date"), "predicted_price")
    return join_actuals(f, p)


@query("apply_actual_prices", forecast_sql(_BACKTEST_AS_OF) + f"""
SELECT a.as_of AS prediction_date, fc.date AS forecast_date, fc.market, fc.predicted_price AS predicted_modal_price,
       {sround('(0.85 - 0.05 * fc.step) * 100', 2)} AS confidence_interval, o.observed_price AS actual_price
FROM fc CROSS JOIN a
LEFT JOIN (SELECT market, date, arg_max(modal_price, id) AS observed_price FROM prices GROUP BY market, date) o
  ON fc.market = o.market AND fc.date = o.date""")
def q_apply_actual_prices(spark, sf):
    # saved predictions made 7 days before the last date get the prices observed since
    from ..operators.quality import apply_actual_prices
    from ..sources.files import to_prediction_rows
    p = _prices(spark, sf)
    a = F.date_sub(p.agg(F.max("date")).scalar(), 7)
    saved = to_prediction_rows(fc.forecast_7d(p, a), a)
    return apply_actual_prices(saved, p).select("prediction_date", "forecast_date", "market", "predicted_modal_price",
                                                "confidence_interval", "actual_price")


@query("generate_predictions", forecast_sql() + f"""
SELECT a.as_of AS prediction_date, fc.date AS forecast_date, market,
       predicted_price * 0.95 AS predicted_min_price, predicted_price * 1.05 AS predicted_max_price,
       predicted_price AS predicted_modal_price, {sround('(0.85 - 0.05 * step) * 100', 2)} AS confidence_interval,
       CAST(NULL AS BIGINT) AS model_used_id, CAST(NULL AS DOUBLE) AS actual_price
FROM fc, a WHERE (SELECT count(*) FROM h) >= 30""")
def q_generate_predictions(spark, sf):
    from ..operators.summary import generate_predictions
    from ..sources.files import new_output_path
    out = generate_predictions(_prices(spark, sf), new_output_path(spark, "generated"))
    return out.select("prediction_date", "forecast_date", "market", "predicted_min_price", "predicted_max_price",
                      "predicted_modal_price", "confidence_interval", "model_used_id", "actual_price")
