import datetime as dt

import pytest

from pricewise.operators import forecast as fc
from pricewise.operators.series import chrono_split, exact_mean, price_sum, usable

D0 = dt.date(2024, 1, 1)


def series(spark, prices, market="M"):
    data = [(i + 1, D0 + dt.timedelta(days=i), market, "S", "D", "Red", float(p)) for i, p in enumerate(prices)]
    return spark.createDataFrame(data, "id long, date date, market string, state string, district string, "
                                       "variety string, modal_price double")


def test_needs_seven_rows(spark):
    assert fc.forecast_7d(series(spark, [1000] * 6)).count() == 0
    assert fc.forecast_7d(series(spark, [1000] * 7)).count() == 7


def test_flat_series_is_flat_and_dates_start_after_as_of(spark):
    out = fc.forecast_bands(fc.forecast_7d(series(spark, [1000] * 10))).orderBy("step").collect()
    assert [r.predicted_price for r in out] == [1000.0] * 7
    assert out[0].date == D0 + dt.timedelta(days=10)
    assert [r.confidence for r in out] == [0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55]
    assert out[0].min_price == 950.0 and out[0].max_price == 1050.0


def test_path_matches_python_recursion(spark):
    prices = [1000, 1010, 1020, 1030, 1040, 1050, 1100, 1150, 1200, 1300]
    out = [r.predicted_price for r in fc.forecast_7d(series(spark, prices)).orderBy("step").collect()]
    avg = sum(prices) / len(prices)
    lo, hi = max(avg * 0.7, 500), avg * 1.3
    trend = (prices[-1] - prices[-7]) / prices[-7]
    exp = [round(sum(prices[-7:]) / 7, 2)]
    for i in range(1, 7):
        exp.append(round(min(max(exp[-1] * (1 + trend * 0.8 ** i), lo), hi), 2))
    assert out == pytest.approx(exp, abs=0.011)
    assert all(lo <= p <= hi for p in out[1:])


def test_trend_classes_and_single_row(spark):
    t = fc.price_trend(series(spark, [100, 106])).first()
    assert t.trend == "Increasing Rapidly" and t.daily_change == 6.0
    t = fc.price_trend(series(spark, [100, 97])).first()
    assert t.trend == "Decreasing"
    t = fc.price_trend(series(spark, [100])).first()
    assert t.trend == "Stable" and t.daily_change == 0.0


def test_recommend_delay_sell(spark):
    s = series(spark, [1000] * 9 + [1000, 1100, 1200, 1300, 1400, 1500, 1600][:0] + [1000])
    trend = fc.price_trend(s)
    forecast = spark.createDataFrame([("M", i, 2000.0) for i in range(7)], "market string, step int, predicted_price double")
    rec = {r.type: r for r in fc.recommend(trend, forecast).collect() if r.user_type == "FARMER"}
    assert "MONITOR" in rec and "DELAY_SELL" in rec
    assert rec["DELAY_SELL"].message == "Prices expected to rise to ₹2000.00 in next week"


def test_market_analysis_short_series_has_error(spark):
    s = series(spark, [1000] * 5, "Tiny").unionByName(series(spark, [1000] * 9, "Big"))
    got = {r.market: r for r in fc.market_analysis(s).collect()}
    assert got["Tiny"].error == "Insufficient data for Tiny" and got["Tiny"].current_price is None
    assert got["Big"].error is None and len(got["Big"].predictions) == 7


def test_mean_is_exact_in_any_order(spark):
    import random
    from fractions import Fraction

    from pyspark.sql import functions as F
    rnd = random.Random(5)
    prices = [rnd.choice([rnd.uniform(1, 2000), -rnd.uniform(1, 9e8), 0.1 + rnd.random() * 1e6, float(rnd.randrange(1 << 50))]) for _ in range(5000)]
    rows = [(p,) for p in prices] + [(None,), (float("nan"),), (float("inf"),), (float("-inf"),)]
    got = set()
    for parts in (1, 7):
        rnd.shuffle(rows)
        g = spark.createDataFrame(rows, "p double").repartition(parts).agg(price_sum("p").alias("s"), F.count(usable("p")).alias("n"))
        got.add(g.select(exact_mean("s", "n").alias("m")).first().m)
    exact = sum(map(Fraction, prices)) / len(prices)
    assert len(got) == 1 and abs(Fraction(got.pop()) / exact - 1) < Fraction(1, 1 << 50)
    none = spark.createDataFrame([(None,)], "p double").agg(price_sum("p").alias("s"), F.count(usable("p")).alias("n"))
    assert none.select(exact_mean("s", "n").alias("m")).first().m is None


def test_chrono_split_floor(spark):
    s = chrono_split(series(spark, [1] * 11), 0.8)
    assert s.filter("is_train").count() == 8


def test_history_guards(spark):
    from pricewise.operators.series import history_guards
    s = series(spark, [1000] * 5, "Tiny").unionByName(series(spark, [1000] * 9, "Mid")) \
        .unionByName(series(spark, [1000] * 20, "Big"))
    got = {r.market: (r.rows, r.status, r.total_rows, r.enough_total) for r in history_guards(s).collect()}
    assert got == {"Tiny": (5, "insufficient", 34, True), "Mid": (9, "limited", 34, True),
                   "Big": (20, "ok", 34, True)}


def test_market_analysis_named_market(spark):
    s = series(spark, [1000] * 9, "Big").unionByName(series(spark, [900] * 9, "Other"))
    got = fc.market_analysis(s, market="Nope").collect()
    assert [(r.market, r.error) for r in got] == [("Nope", "Market 'Nope' not found in data")]
    got = fc.market_analysis(s, market="Big").collect()
    assert [(r.market, r.current_price, r.error) for r in got] == [("Big", 1000.0, None)]


def test_generate_predictions_guards_and_writes(spark, tmp_path):
    from pricewise.operators.summary import generate_predictions
    small = series(spark, [1000] * 9, "A")                                   # 9 rows < 30: nothing written
    assert generate_predictions(small, str(tmp_path / "p1")).count() == 0
    big = small.unionByName(series(spark, [900] * 25, "B"))                 # 34 rows: both markets
    out = generate_predictions(big, str(tmp_path / "p2")).collect()
    assert sorted({r.market for r in out}) == ["A", "B"] and len(out) == 14
    assert {r.confidence_interval for r in out} == {85.0, 80.0, 75.0, 70.0, 65.0, 60.0, 55.0}
    # the guard counts the whole table, not the rows of the market asked for
    assert sorted({r.market for r in generate_predictions(big, str(tmp_path / "p3"), market="a").collect()}) == ["A"]
