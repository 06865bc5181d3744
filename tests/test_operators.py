"""Per-operator checks on tiny hand-made frames: joins, aggregates, encoding, sources, models."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from pricewise.operators import aggregates as A
from pricewise.operators import encode as E
from pricewise.operators import selection as S
from pricewise.sources import files as IO

D0 = dt.date(2024, 1, 1)


@pytest.fixture()
def prices(spark):
    rows = [(1, D0, "A", "S1", "D1", "Red", 90.0, 110.0, 100.0, 5.0),
            (2, D0 + dt.timedelta(days=1), "A", "S1", "D1", "Red", 90.0, 130.0, 120.0, None),
            (3, D0, "B", "S2", "D2", "White", 40.0, 60.0, 50.0, 1.0),
            (4, D0 + dt.timedelta(days=1), "B", "S2", "D2", "White", 40.0, 60.0, 50.0, 2.0)]
    return spark.createDataFrame(rows, "id long, date date, market string, state string, district string, "
                                       "variety string, min_price double, max_price double, modal_price double, "
                                       "arrival_quantity double")


def test_joins(spark):
    users = spark.createDataFrame([(1, "ann"), (2, "bob"), (3, "cid")], "user_id long, username string")
    profiles = spark.createDataFrame([(1, "FARMER"), (2, "TRADER")], "user_id long, user_type string")
    assert [r.user_id for r in S.join_users_profiles(users, profiles, "TRADER").collect()] == [2]
    d = {r.user_id: r.user_type for r in S.join_user_type_default(users, profiles).collect()}
    assert d == {1: "FARMER", 2: "TRADER", 3: "GENERAL"}
    assert sorted(r.user_id for r in S.semi_existing(users, profiles, ["user_id"]).collect()) == [1, 2]
    assert [r.user_id for r in S.anti_new(users, profiles, ["user_id"]).collect()] == [3]
    assert [r.user_id for r in S.join_search_username(users, profiles, "AN").collect()] == [1]
    preds = spark.createDataFrame([(10, 1), (11, None), (12, 5)], "id long, model_used_id long")
    models = spark.createDataFrame([(1, "LSTM")], "id long, name string")
    got = {r.id: r.model_name for r in S.join_prediction_model(preds, models).collect()}
    assert got == {10: "LSTM", 11: None, 12: None}


def test_dashboard_and_stats(spark, prices):
    preds = spark.createDataFrame([(1,)], "id long")
    t = A.dashboard_totals(prices, preds, preds).first()
    assert (t.total_prices, t.total_predictions, t.total_users, t.avg_price) == (4, 1, 1, 80.0)
    s = A.price_stats(prices).first()
    assert s.highest_id == 2 and s.lowest_id == 3      # tie on 50.0 -> lowest id
    assert A.avg_price_by_market(prices).filter("market = 'A'").first().avg_price == 110.0
    ch = A.price_change_pct(prices, D0, D0 + dt.timedelta(days=1)).first()
    assert ch.price_change_pct == 0.0                   # both windows cover both days
    miss = {r.column: r.missing for r in A.profile_missing(prices).collect()}
    assert miss == {"arrival_quantity": 1}
    assert A.profile_date_span(prices).first().total_days == 1
    lc = {r.column: r.below_limit for r in A.low_cardinality_check(prices, ("market",), 2).collect()}
    assert lc == {"market": False}


def test_regression_metrics_and_best(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 4.0)], "y double, p double")
    m = A.regression_metrics(df, "y", "p").first()
    assert m.mse == pytest.approx(1 / 3) and m.mae == pytest.approx(1 / 3)
    assert m.r2 == pytest.approx(1 - 1 / 2)
    metrics = spark.createDataFrame([("lr", 0.7), ("rf", 0.7), ("xgb", -0.1)], "model string, r2 double")
    b = A.select_best_model(metrics).first()
    assert (b.best_model, b.verdict) == ("lr", "good")


def test_one_hot_and_label_encode(spark, prices):
    d, names = E.one_hot(prices, ("market", "variety"))
    assert names == ["market_B", "variety_White"]
    assert {r.id: (r.market_B, r.variety_White) for r in d.collect()}[3] == (1, 1)
    aligned = E.one_hot_align(prices.withColumn("market", F.lit("Z")), names, ("market", "variety"))
    assert {r.market_B for r in aligned.collect()} == {0}
    le, _ = E.label_encode(prices, ("market",))
    assert {r.market: r.market_code for r in le.collect()} == {"A": 0, "B": 1}
    sc = E.standard_scale(prices, prices, ["modal_price"]).agg(F.avg("modal_price_scaled")).first()[0]
    assert sc == pytest.approx(0.0)


def test_sources_round_trip(spark, prices, tmp_path):
    out = IO.export_prices_csv(prices, str(tmp_path / "p"), market="a")
    back = IO.read_prices_csv(spark, out)
    assert sorted(r.modal_price for r in back.collect()) == ["100.0", "120.0"]
    j = [json.loads(r.json) for r in IO.prices_json(prices, D0 + dt.timedelta(days=1), 60, "a").collect()]
    assert {x["modal_price"] for x in j} == {100.0, 120.0}
    app = IO.append_prices(prices, prices.drop("arrival_quantity").withColumn("id", F.col("id") + 10))
    assert app.count() == 8 and app.filter("id > 10 AND arrival_quantity = 0").count() == 4
    fc = spark.createDataFrame([("A", 0, D0, 100.0)], "market string, step int, date date, predicted_price double")
    pj = json.loads(IO.prediction_json(fc).first().json)
    assert pj == {"date": "2024-01-01", "predicted_price": 100.0, "lower_bound": 95.0, "upper_bound": 105.0}


def test_models_fit_and_reload(spark, tmp_path):
    from pricewise.operators import ml as M
    rows = [(float(i), float(2 * i + 1)) for i in range(50)]
    df = spark.createDataFrame(rows, "x double, y double")
    m = M.train_linear(df, ["x"], "y", scale=False)
    c = {r.feature: r.coefficient for r in M.coefficients(m, ["x"]).collect()}
    assert c["x"] == pytest.approx(2.0) and c["intercept"] == pytest.approx(1.0)
    path = M.save_model(m, str(tmp_path / "m"))
    p = M.load_model(path).transform(df).filter("x = 10").first().prediction
    assert p == pytest.approx(21.0)


def test_label_encode_paths_agree(spark, prices):
    a, _ = E.label_encode(prices, ("market", "variety"))                       # distributed
    b = E.label_indexer(("market", "variety")).fit(prices).transform(prices)   # labels held by the driver
    key = lambda df: sorted((r.id, r.market_code, r.variety_code) for r in df.collect())
    assert key(a) == key(b) == [(1, 0, 0), (2, 0, 0), (3, 1, 1), (4, 1, 1)]


def test_means_of_very_large_sums_and_of_unknown_prices(spark):
    """Unit sums beyond a BIGINT, and NaN, infinite and null prices, which no mean counts."""
    from datetime import date, timedelta

    from pricewise.operators import aggregates as A
    from pricewise.operators.forecast import price_trend, series_summary
    from pricewise.operators.series import rolling_mean_partial, tail_stats
    schema = "id bigint, date date, market string, state string, district string, variety string, modal_price double"
    day = lambda i: date(2024, 1, 1) + timedelta(i)
    big = spark.createDataFrame([(i, day(i % 300), "m", "s", "d", "v", 9e13) for i in range(40)], schema)
    assert A.price_stats(big).first()["avg_price"] == 9e13
    assert series_summary(big).first()["series_avg"] == 9e13
    assert {r["price_ma_30"] for r in rolling_mean_partial(big, 30).collect()} == {9e13}
    odd = spark.createDataFrame([(i, day(i), "m", "s", "d", "v", p) for i, p in enumerate([float("nan"), 10.0, None, float("inf"), 20.0, 30.0])], schema)
    assert A.price_stats(odd).first()["avg_price"] == 20.0
    assert series_summary(odd).first()["series_avg"] == 20.0
    assert price_trend(odd).first()["avg_30d"] == 20.0
    assert tail_stats(odd, 7).select("avg_7", "rows_7").first()[:] == (20.0, 6)
    assert [r["price_ma_3"] for r in rolling_mean_partial(odd, 3).orderBy("id").collect()] == [None, 10.0, 10.0, 10.0, 20.0, 25.0]


def test_simple_features_take_every_row(spark):
    p = spark.createDataFrame([(i, "A", D0 + dt.timedelta(days=i), 100.0 + i % 7) for i in range(400)],
                              "id long, market string, date date, modal_price double")
    for hot in (False, True):
        d, _ = E.build_features_simple(p, encode=False, hot_series=hot)
        assert sorted(r.id for r in d.select("id").collect()) == list(range(7, 400))


def test_label_codes_count_rows_that_are_dropped(spark):
    p = spark.createDataFrame([(i, "A", "old" if i < 50 else "recent", D0 + dt.timedelta(days=i), 100.0 + i % 7) for i in range(120)],
                              "id long, market string, variety string, date date, modal_price double")
    d, _ = E.build_features_full(p)
    assert {r.variety_code for r in d.collect()} == {1}


def test_forecast_recursive_reports_short_series(spark, tmp_path):
    from pricewise.operators import ml as M
    rows = [(i, m, D0 + dt.timedelta(days=i), 100.0 + (i * 7) % 11) for m, n in (("A", 30), ("B", 7), ("C", 3)) for i in range(n)]
    p = spark.createDataFrame(rows, "id long, market string, date date, modal_price double")
    m = M.train_linear(M.recursive_training_frame(p), M.RECURSIVE_FEATURES)
    out = M.forecast_recursive(m, p, horizon=3, checkpoint_every=0).collect()
    assert sorted((r.market, r.step) for r in out if r.status == "ok") == [(k, i) for k in "AB" for i in range(3)]
    assert all(r.predicted_price is not None and r.date is not None for r in out if r.status == "ok")
    assert [tuple(r) for r in out if r.status != "ok"] == [("C", None, None, None, "insufficient")]


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="driver test data not present")
def test_forecast_recursive_query_runs_thirty_steps(spark):
    import __spark_entry__ as Q
    out = Q.queries()["forecast_recursive"](spark, "/root/testdata/sf0.001")
    assert out.filter("status = 'ok'").agg(F.count_distinct("step")).first()[0] == 30
