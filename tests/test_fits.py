"""Fits by key, recursive forecasts, rank selection, sparse dummies: against numpy and plain Python."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricewise.operators import aggregates as A
from pricewise.operators import encode as E
from pricewise.operators import ml as M
from pricewise.operators import ranks as R
from pricewise.operators import selection as S

D0 = dt.date(2023, 1, 1)


def prices(spark, days, seed=1):
    rnd = random.Random(seed)
    rows, i = [], 0
    for market, n in days.items():
        for d in range(n):
            i += 1
            rows.append((i, D0 + dt.timedelta(days=d * 3), market, "S" + market[:1], ["Red", "White", "Local"][i % 3], float(900 + 50 * np.sin(d / 9) + rnd.uniform(-20, 20))))
    return spark.createDataFrame(rows, "id long, date date, market string, state string, variety string, modal_price double")


def test_least_squares_by_key(spark):
    rnd = np.random.default_rng(2)
    rows = []
    for k, n in (("a", 200), ("b", 30), ("c", 3), (None, 40)):
        x = rnd.normal(size=(n, 3)) + [5, 0, -2]
        y = x @ [2.0, -1.0, 0.5] + 7 + rnd.normal(size=n) * 0.1
        rows += [(k, *map(float, r), float(v)) for r, v in zip(x, y)]
    bad = [("a", None, 1.0, 1.0, 1.0), ("a", 1.0, float("nan"), 1.0, 1.0), ("a", 1.0, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows + bad, "k string, x1 double, x2 double, x3 double, y double").withColumn("copy", F.col("x1") * 2)
    got = {r.k: r for r in M.least_squares(df, ["x1", "x2", "x3", "copy"], "y", ["k"], top=F.max("y")).collect()}
    for k in ("a", "b", None):
        mine = np.array([r[1:] for r in rows if r[0] == k])
        x = np.column_stack([np.ones(len(mine)), mine[:, :3]])
        want, sse, *_ = np.linalg.lstsq(x, mine[:, 3], rcond=None)
        assert np.allclose(got[k].coef[:4], want, atol=1e-7) and got[k].coef[4] == 0  # the copy is left out
        assert got[k].sse == pytest.approx(sse[0], rel=1e-6) and got[k].n == len(mine) and got[k].top == max(mine[:, 3])
    few = np.array([r[1:] for r in rows if r[0] == "c"])
    assert np.allclose([np.dot([1, *x[:3]], got["c"].coef[:4]) for x in few], few[:, 3], atol=1e-6)  # three rows: an exact fit


def test_seasonal_curve_of_each_market(spark):
    p = prices(spark, {"A": 200, "B": 150, "one": 1})
    got = M.train_seasonal(p, horizon=5, keys=["market"]).collect()
    assert {r.market for r in got} == {"A", "B"}
    hol = spark.createDataFrame([(d,) for d in M.DEFAULT_HOLIDAYS], "d string").select(F.col("d").cast("date").alias("date"))
    for market in ("A", "B"):
        design = lambda df: np.array([[r[c] for c in M.SEASONAL_FEATURES] for r in M.seasonal_design(df.withColumn("origin", F.lit(D0)), hol).orderBy("date").collect()])
        mine = p.filter(F.col("market") == market)
        y = np.log([r.modal_price for r in mine.orderBy("date").collect()])
        x = design(mine.select("date"))
        some = [i for i in range(x.shape[1]) if np.linalg.matrix_rank(np.column_stack([np.ones(len(x)), x[:, :i + 1]])) > np.linalg.matrix_rank(np.column_stack([np.ones(len(x)), x[:, :i]]))]
        coef, *_ = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x[:, some]]), y, rcond=None)
        sd = np.std(y - np.column_stack([np.ones(len(x)), x[:, some]]) @ coef, ddof=1)
        rows = sorted((r for r in got if r.market == market), key=lambda r: r.ds)
        last = mine.agg(F.max("date")).first()[0]
        assert [r.ds for r in rows] == [last + dt.timedelta(days=i) for i in range(1, 6)]
        future = spark.createDataFrame([(r.ds,) for r in rows], "date date")
        want = np.column_stack([np.ones(5), design(future)[:, some]]) @ coef
        assert np.allclose([r.yhat for r in rows], np.exp(want), rtol=1e-6)
        assert np.allclose([r.yhat_upper / r.yhat for r in rows], np.exp(1.2816 * sd), rtol=1e-6)
        assert all(r.yhat_lower < r.yhat < r.yhat_upper for r in rows)


def test_recursive_fold_equals_the_step_loop(spark, monkeypatch):
    p = prices(spark, {"A": 60, "B": 40, "C": 3})
    for scale in (True, False):
        m = M.train_linear(M.recursive_training_frame(p), M.RECURSIVE_FEATURES, scale=scale)
        fold = sorted(map(tuple, M.forecast_recursive(m, p, horizon=9).collect()), key=str)
        with monkeypatch.context() as mp:
            mp.setattr(M, "linear_terms", lambda model: None)
            loop = sorted(map(tuple, M.forecast_recursive(m, p, horizon=9, checkpoint_every=4).collect()), key=str)
        assert [r[:2] + r[3:] for r in fold] == [r[:2] + r[3:] for r in loop]
        assert np.allclose([r[2] or 0 for r in fold], [r[2] or 0 for r in loop], rtol=1e-9)
    first = p.agg(F.max("date")).first()[0]
    assert {r[3] for r in fold if r[1] == 0} == {first + dt.timedelta(days=1)}  # as_of + 1 for every market
    early = M.forecast_recursive(m, p, horizon=2, as_of=str(D0 + dt.timedelta(days=60))).filter("status = 'ok'").collect()
    assert {r.date for r in early} == {D0 + dt.timedelta(days=61), D0 + dt.timedelta(days=62)}


def test_train_all_keeps_nothing_cached(spark):
    d, _ = E.build_features_simple(prices(spark, {"A": 60, "B": 50}), leak_free=True, encode=False)
    held = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    fitted, metrics = M.train_all(d, models=("lr", "rf"), rf={"trees": 3, "depth": 3})
    assert sorted(r.model for r in metrics.collect()) == ["lr", "rf"] and sorted(fitted) == ["lr", "rf"]
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == held


def ranked_rows(spark, n=3000):
    rnd = random.Random(4)
    rows = [(i, rnd.choice([None, "b", "b", "a", "c"]), rnd.choice([1.5, None, 2.0, float("nan")]) if i % 3 else 7.0, D0 + dt.timedelta(days=rnd.randrange(40))) for i in range(n)]
    return spark.createDataFrame(rows, "id long, s string, v double, d date").repartition(5)


@pytest.mark.parametrize("spec", [["id"], ["-d", "id"], ["s", "-v", "-id"], ["-s", "v", "d", "id"]])
def test_pages_are_slices_of_the_order(spark, monkeypatch, spec):
    monkeypatch.setattr(R, "KEYS", 20)
    monkeypatch.setattr(R, "CUTS", 5)
    df = ranked_rows(spark)
    want = [r.id for r in df.orderBy(*R.sort_columns(R.order_of(spec))).collect()]
    for page in (1, 2, 31, 60, 99):
        p = min(page, 60)
        got = S.paginate(df, spec, 50, page)
        assert [r.id for r in got.collect()] == want[(p - 1) * 50:p * 50]


def test_no_page_sorts_more_than_itself(spark):
    df = spark.range(20000).withColumn("k", F.col("id") * 7 % 20000).drop("id")
    for page in (1, 200, 400):
        plan = S.paginate(df, [F.col("k").desc()], 50, page)._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrderedAndProject(limit=50" in plan and "offset" not in plan.lower()
    assert S.paginate(df.limit(0), ["k"], 50, 3).count() == 0
    with pytest.raises(ValueError):
        S.paginate(df, [F.col("k") + 1], 50, 2)


def test_quantile_by_narrowing(spark, monkeypatch):
    monkeypatch.setattr(R, "KEYS", 10)
    monkeypatch.setattr(R, "CUTS", 4)
    rnd = random.Random(6)
    for values in ([rnd.uniform(-5, 5) for _ in range(1001)], [rnd.choice([1.0, 2.0, 2.0, 9.5]) for _ in range(800)], [3.0] * 500, [1.0, 4.0]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "x double").repartition(3)
        for q in (0.0, 0.25, 0.5, 1.0):
            assert df.limit(1).select(A.exact_quantile(df, "x", q)).first()[0] == pytest.approx(float(np.quantile(values, q)), rel=1e-12)
    assert spark.range(1).select(A.exact_quantile(df.filter("x is null"), "x")).first()[0] is None


def test_sparse_dummies(spark):
    p = prices(spark, {"A": 5, "B": 4, "C": 6}).withColumn("only", F.lit("x"))
    p = p.unionByName(p.limit(1).withColumns({"id": F.lit(99).cast("long"), "market": F.lit(None).cast("string")}))
    fitted = E.one_hot_fit(p, ("market", "variety", "only"))
    got = {r.id: r.dummies for r in E.one_hot_vectors(p, fitted).collect()}
    want, names = E.one_hot(p, ("market", "variety"), drop_source=False)
    assert len(names) == 4
    for r in want.collect():
        v = got[r.id]
        assert v.toArray().tolist() == [float(r[n] or 0) for n in names]
    many = spark.range(500).withColumn("c", F.concat(F.lit("v"), F.col("id").cast("string")))
    assert {(type(r.dummies).__name__, r.dummies.size) for r in E.one_hot_vectors(many, E.one_hot_fit(many, ["c"])).collect()} == {("SparseVector", 499)}
    unseen = E.one_hot_vectors(p.limit(1).withColumns({"market": F.lit("Z"), "variety": F.lit("Q")}), fitted).first().dummies
    assert unseen.toArray().tolist() == [0.0] * 4
    d = E.one_hot_vectors(p.filter("id < 90"), fitted)
    m = M.train_linear(d, ["dummies"], "modal_price", scale=False)
    assert [r.feature for r in M.coefficients(m, ["dummies"]).collect()] == [*[f"dummies[{i}]" for i in range(4)], "intercept"]


def test_scale_reads_its_fit_once(spark):
    p = prices(spark, {"A": 30, "B": 20})
    plan = E.standard_scale(p, p, ["modal_price", "id"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "scalar-subquery" not in plan


def test_metrics_of_several_columns(spark):
    df = spark.createDataFrame([(1.0, 1.0, 2.0), (2.0, 2.0, None), (3.0, 4.0, 3.0)], "modal_price double, p double, q double")
    got = {r.model: r for r in A.metrics_by_column(df, ["p", "q"]).collect()}
    for c in ("p", "q"):
        one = A.regression_metrics(df, "modal_price", c).first()
        assert (got[c].mse, got[c].mae, got[c].r2, got[c].n) == (one.mse, one.mae, one.r2, one.n)


def test_filter_in_lists_on_both_sides_of_the_limit(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    for n in (0, 3, S.ISIN_LIMIT, S.ISIN_LIMIT + 1, 2500):
        ids = list(range(0, 2 * n, 2))
        assert [r.k for r in S.filter_in(df, "k", ids).orderBy("k").collect()] == [i for i in ids if i < 5000], n


def test_linear_fit_of_more_columns_than_the_normal_equations_take(spark):
    """5,000 dummies; the fit reaches the least squares that the group means give."""
    n, per = 5000, 3
    df = spark.range(n * per).select((F.col("id") % n).cast("string").alias("c"), F.sin("id").alias("x"), F.cos(F.col("id") * 3).alias("e")) \
        .withColumn("y", 2 * F.col("x") + F.hash("c") % 7 + F.col("e"))
    rows = E.one_hot_vectors(df, E.one_hot_fit(df, ["c"]))
    m = M.train_linear(rows, ["x", "dummies"], "y", scale=False)
    got = {r.feature: r.coefficient for r in M.coefficients(m, ["x", "dummies"]).collect()}
    d = df.toPandas()
    x, y = (d[k] - d.groupby("c")[k].transform("mean") for k in ("x", "y"))
    assert len(got) == n + 1 and got["x"] == pytest.approx((x * y).sum() / (x * x).sum(), rel=1e-3)


def test_tree_fits_read_few_parts_and_keep_nothing_cached(spark):
    """as many parts as cores, whatever the layout; only the columns of the fit."""
    d, _ = E.build_features_simple(prices(spark, {"A": 80, "B": 70}), leak_free=True, encode=False)
    rows = M._training_rows(d.repartition(60), M.SIMPLE_FEATURES, "modal_price", held=False)
    assert rows.columns == [*M.SIMPLE_FEATURES, "modal_price"]
    cores = spark.sparkContext.defaultParallelism
    spread = spark.range(0, 1000, 1, 10 * cores)
    assert M._in_few_parts(spread).rdd.getNumPartitions() == cores and M._in_few_parts(spread).count() == 1000
    held = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    M.train_random_forest(d, M.SIMPLE_FEATURES, trees=2, depth=2)
    M.train_linear(d, M.SIMPLE_FEATURES)
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == held


def test_training_report_computes_its_features_once(spark, monkeypatch):
    """one split, written once, serves the fits, the scores and the baseline."""
    from pricewise.operators import series, summary
    calls = []
    split = series.chrono_split
    monkeypatch.setattr(series, "chrono_split", lambda *a, **k: calls.append(1) or split(*a, **k))
    monkeypatch.setattr(M, "chrono_split", lambda *a, **k: calls.append(1) or split(*a, **k))
    p = prices(spark, {"A": 60, "B": 50}).withColumns({c: F.col("modal_price") for c in ("min_price", "max_price", "arrival_quantity")}).withColumn("district", F.lit("D"))
    report = summary.training_report(p, models=("lr", "rf"), rf={"trees": 2, "depth": 2})
    names = {(r.section, r.name) for r in report.collect()}
    assert len(calls) == 1 and {("metric", "lr.r2"), ("metric", "rf.mae"), ("metric", "baseline.r2")} <= names


def test_fits_by_one_pass_over_the_windows(spark):
    """what a fit reads is a table of its columns, not the windows again at every pass."""
    frame = M.recursive_training_frame(prices(spark, {"A": 60, "B": 40}))
    rows = M._training_rows(frame, M.RECURSIVE_FEATURES, "modal_price", held=False)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "InMemoryTableScan" not in plan and rows.count() == frame.count()
