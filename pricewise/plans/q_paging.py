"""Registered queries: sorts, limits, top-k and paging (survey 2.8)."""

from pyspark.sql import functions as F

from ..operators import selection as S
from ..sources.canonical import table
from .registry import query

PRICE_COLS = "id, date, market, state, district, variety, min_price, max_price, modal_price, arrival_quantity"


def T(spark, sf, name):
    return table(spark, sf, name)


@query("top_recent", f"SELECT {PRICE_COLS} FROM prices ORDER BY date DESC, id DESC LIMIT 10")
def q_top_recent(spark, sf):
    return S.top_recent(T(spark, sf, "prices"), 10)


@query("top_recent_predictions", "SELECT * FROM predictions ORDER BY forecast_date DESC, id DESC LIMIT 7")
def q_top_recent_predictions(spark, sf):
    return S.top_recent(T(spark, sf, "predictions"), 7, "forecast_date")


@query("sort_by", "SELECT * FROM factors ORDER BY impact_score DESC, id")
def q_sort_by(spark, sf):
    return S.sort_by(T(spark, sf, "factors"), F.col("impact_score").desc(), "id")


@query("extreme_row", f"SELECT {PRICE_COLS} FROM prices ORDER BY modal_price DESC, id LIMIT 1")
def q_extreme_row(spark, sf):
    return S.extreme_row(T(spark, sf, "prices"), "modal_price", True)


@query("extreme_row_lowest", f"SELECT {PRICE_COLS} FROM prices ORDER BY modal_price, id LIMIT 1")
def q_extreme_row_lowest(spark, sf):
    return S.extreme_row(T(spark, sf, "prices"), "modal_price", False)


@query("paginate", f"SELECT {PRICE_COLS} FROM prices ORDER BY date DESC, id DESC LIMIT 50 OFFSET 100")
def q_paginate(spark, sf):
    return S.paginate(T(spark, sf, "prices"), [F.col("date").desc(), F.col("id").desc()], 50, 3)


@query("paginate_clamped", """
SELECT * FROM predictions ORDER BY forecast_date DESC, id DESC
LIMIT 5 OFFSET (SELECT (CAST(ceil(count(*) / 5) AS BIGINT) - 1) * 5 FROM predictions)""")
def q_paginate_clamped(spark, sf):
    # page 10**9 is past the end: clamped to the last page
    return S.paginate(T(spark, sf, "predictions"), [F.col("forecast_date").desc(), F.col("id").desc()], 5, 10**9)


@query("paginate_middle", f"""
SELECT {PRICE_COLS} FROM prices ORDER BY market, date DESC, id
LIMIT 50 OFFSET (SELECT CAST(floor(count(*) / 100) AS BIGINT) * 50 FROM prices)""")
def q_paginate_middle(spark, sf):
    p = T(spark, sf, "prices")
    total = p.count()
    return S.paginate(p, ["market", "-date", "id"], 50, total // 100 + 1, total)


@query("page_after", f"""
SELECT {PRICE_COLS} FROM prices WHERE date < DATE '2000-01-01' OR (date = DATE '2000-01-01' AND id < 0)
ORDER BY date DESC, id DESC LIMIT 20""")
def q_page_after(spark, sf):
    import datetime as dt
    return S.page_after(T(spark, sf, "prices"), ("date", "id"), (dt.date(2000, 1, 1), 0), 20)


@query("natural_sort", """
SELECT *, TRY_CAST(regexp_replace(CAST(username AS VARCHAR), '[^0-9.\\-]', '', 'g') AS DOUBLE) AS natural_key
FROM users ORDER BY natural_key NULLS LAST, username""")
def q_natural_sort(spark, sf):
    return S.natural_sort(T(spark, sf, "users"), "username")


@query("chart_top15", f"""
SELECT id, substr(market, 1, 10) AS label,
       coalesce(CASE WHEN actual_price IS NOT NULL AND actual_price <> 0 AND predicted_modal_price <> 0
                     THEN 100 - abs(predicted_modal_price - actual_price) / actual_price * 100 END, 0.0) AS accuracy,
       CAST(85.0 AS DOUBLE) AS target
FROM predictions ORDER BY forecast_date DESC, id DESC LIMIT 15""")
def q_chart_top15(spark, sf):
    return S.chart_top15(T(spark, sf, "predictions"))


@query("historical_data", f"""
SELECT {PRICE_COLS} FROM prices WHERE lower(market) = 'supplier#000000021'
  AND date BETWEEN DATE '1998-01-01' AND DATE '1999-06-30' ORDER BY date DESC, id DESC""")
def q_historical_data(spark, sf):
    from ..operators.summary import historical_data
    return historical_data(T(spark, sf, "prices"), "SUPPLIER#000000021", "1998-01-01", "1999-06-30")


@query("prediction_results", """
SELECT * FROM predictions
WHERE lower(market) = 'furniture'
  AND prediction_date >= CAST((SELECT max(prediction_date) FROM predictions) - INTERVAL 90 DAY AS DATE)
  AND actual_price IS NOT NULL
ORDER BY forecast_date DESC, id DESC LIMIT 100""")
def q_prediction_results(spark, sf):
    from ..operators.summary import prediction_results
    return prediction_results(T(spark, sf, "predictions"), "Furniture", "quarter", "verified")
