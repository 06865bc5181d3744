"""Properties from the survey's test strategy, checked on small random frames."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pricewise.functions import scalars as X
from pricewise.operators import forecast as fc
from pricewise.operators import quality as Q

SET = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
D0 = dt.date(2024, 1, 1)
keys = st.tuples(st.sampled_from(["A", "B", "C"]), st.integers(0, 4))


@SET
@given(st.dictionaries(keys, st.floats(1, 1000), min_size=1, max_size=10),
       st.lists(st.tuples(keys, st.floats(1, 1000)), min_size=1, max_size=10))
def test_upsert_properties(spark, target, source):
    t = spark.createDataFrame([(i, D0 + dt.timedelta(days=d), m, v) for i, ((m, d), v) in enumerate(target.items())],
                              "id long, date date, market string, modal_price double")
    s = spark.createDataFrame([(None, D0 + dt.timedelta(days=d), m, v, r) for r, ((m, d), v) in enumerate(source)],
                              "id long, date date, market string, modal_price double, file_row long")
    out = {(r.market, (r.date - D0).days): r.modal_price for r in Q.upsert_prices(t, s).collect()}
    expect = dict(target)
    for (k, v) in source:          # later file rows win
        expect[k] = v
    assert out == expect
    once = Q.upsert_prices(t, s)
    assert sorted(map(tuple, Q.upsert_prices(once, s).collect())) == sorted(map(tuple, once.collect()))


@SET
@given(st.lists(st.tuples(st.one_of(st.none(), st.floats(-10, 100)), st.floats(-10, 100)), min_size=1, max_size=20))
def test_delete_plus_kept_is_everything(spark, rows):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "id long, a double, b double")
    kept, n = Q.delete_by_filter(df, F.col("a") > F.col("b"))
    assert kept.count() + n.first().deleted == len(rows)


@SET
@given(st.lists(st.tuples(st.sampled_from(["1", "2", "x", "", "NaN", "-1"]), st.sampled_from(["1", "3", "5"]),
                          st.sampled_from(["2", "4", "9"])), min_size=1, max_size=15))
def test_reject_plus_accept_is_input(spark, rows):
    data = [(i, "2024-01-01", "M", "S", "D", "V", mn, mx, md) for i, (mn, md, mx) in enumerate(rows)]
    df = spark.createDataFrame(data, "file_row long, date string, market string, state string, district string, "
                                     "variety string, min_price string, max_price string, modal_price string")
    v = Q.validate_prices(df)
    ok = v.filter(F.col("reject_reason").isNull())
    assert ok.count() + v.filter(F.col("reject_reason").isNotNull()).count() == len(rows)
    for r in ok.collect():
        assert 0 < r.min_price <= r.modal_price <= r.max_price


@SET
@given(st.lists(st.integers(500, 3000), min_size=7, max_size=40))
def test_forecast_within_bounds(spark, prices):
    data = [(i + 1, D0 + dt.timedelta(days=i), "M", "S", "D", "V", float(p)) for i, p in enumerate(prices)]
    df = spark.createDataFrame(data, "id long, date date, market string, state string, district string, "
                                     "variety string, modal_price double")
    out = fc.forecast_7d(df).orderBy("step").collect()
    assert len(out) == 7
    for r in out[1:]:
        assert r.lower_bound - 0.005 <= r.predicted_price <= r.upper_bound + 0.005


@SET
@given(st.lists(st.tuples(st.floats(0.01, 1e6), st.floats(0.01, 1e6)), min_size=1, max_size=20))
def test_accuracy_at_most_100(spark, pairs):
    df = spark.createDataFrame(pairs, "p double, a double")
    for r in df.select(X.accuracy_pct("p", "a").alias("x")).collect():
        assert r.x <= 100.0
