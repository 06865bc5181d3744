"""The split (hot-key) series operators equal the window ones, with a market holding most rows."""

import datetime as dt
import random

from pricewise.operators import long_series as LS
from pricewise.operators import series as S

D0 = dt.date(2024, 1, 1)


def hot_prices(spark):
    rnd = random.Random(3)
    rows, i = [], 0
    for m, per_day in (("HOT", 40), ("A", 1), ("B", 2)):
        for d in range(30):
            for _ in range(per_day):
                i += 1
                rows.append((i, D0 + dt.timedelta(days=d), m, round(rnd.uniform(900, 1000), 2)))
    return spark.createDataFrame(rows, "id long, date date, market string, modal_price double")


def by_id(df, cols):
    return {r.id: tuple(r[c] for c in cols) for r in df.collect()}


def test_split_equals_window(spark):
    p = hot_prices(spark)
    cols = ["price_lag_1", "price_lag_7", "price_lag_90"]
    assert by_id(LS.lag_split(p, (1, 7, 90), partitions=7), cols) == by_id(S.lag_features(p, (1, 7, 90)), cols)
    for full in (False, True):
        a = LS.rolling_mean_split(p, 30, full=full, name="m", partitions=7)
        b = (S.rolling_mean_full if full else S.rolling_mean_partial)(p, 30, name="m")
        assert by_id(a, ["m"]) == by_id(b, ["m"])
    assert by_id(LS.pct_change_split(p, 7, partitions=5), ["price_change_7"]) == \
        by_id(S.pct_change(p, 7), ["price_change_7"])


def same(a, b):
    return a == b or (a != a and b != b)


def test_split_equals_window_with_null_and_nan_rows(spark):
    """Small blocks, so that most windows reach into a border; null, NaN and infinite prices, a null market."""
    rnd = random.Random(9)
    rows = [(i, D0 + dt.timedelta(days=i // 5), rnd.choice(["HOT"] * 8 + ["A", None]),
             rnd.choice([None, float("nan"), float("inf"), 0.0, *[rnd.uniform(900, 1000)] * 8])) for i in range(700)]
    p = spark.createDataFrame(rows, "id long, date date, market string, modal_price double")
    for n, block in ((1, 8), (7, 8), (7, 3), (30, 64)):
        pairs = [(LS.lag_split(p, (1, n), partitions=6, block=block), S.lag_features(p, (1, n)), f"price_lag_{n}"),
                 (LS.rolling_mean_split(p, n, partitions=6, block=block, name="m"), S.rolling_mean_partial(p, n, name="m"), "m"),
                 (LS.rolling_mean_split(p, n, partitions=6, block=block, name="m", full=True), S.rolling_mean_full(p, n, name="m"), "m"),
                 (LS.pct_change_split(p, n, partitions=6, block=block), S.pct_change(p, n), f"price_change_{n}"),
                 (LS.in_blocks(p, n - 1, lambda d, k: S.rolling_std_full(d, n, keys=k, name="m"), partitions=6, block=block), S.rolling_std_full(p, n, name="m"), "m")]
        for a, b, c in pairs:
            a, b = by_id(a, [c]), by_id(b, [c])
            assert a.keys() == b.keys() and all(same(a[k][0], b[k][0]) for k in a), (n, block, c)


def test_one_shuffle_for_all_features(spark):
    from pricewise.operators.encode import _full_windows
    p = hot_prices(spark)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        d = LS.in_blocks(p, 90, lambda d, k: _full_windows(d, k, False, "modal_price"), partitions=6, block=256)
        plan = d._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    by_block = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "_block" in x]
    assert len(by_block) == 1
    # besides that one, only the table of pieces (a row per key and partition) is dealt out
    assert not [x for x in plan.splitlines() if "rangepartitioning" in x]


def test_hot_series_spans_partitions(spark):
    from pyspark.sql import functions as F
    pos = LS.series_positions(hot_prices(spark), partitions=6)
    hot = pos.filter("market = 'HOT'")
    assert sorted(r["_i"] for r in hot.select("_i").collect()) == list(range(1200))
    # the hot market's rows were laid out over several partitions, not one task
    laid = hot_prices(spark).repartitionByRange(6, "market", "date", "id")
    assert laid.filter("market = 'HOT'").select(F.spark_partition_id()).distinct().count() > 1


def test_feature_set_split_equals_window(spark):
    from pricewise.operators.encode import build_features_simple
    p = hot_prices(spark)
    cols = ["price_lag_1", "price_lag_7", "price_ma_7", "price_ma_30", "price_change_1", "price_change_7"]
    for leak_free in (False, True):
        a, _ = build_features_simple(p, leak_free=leak_free, encode=False, hot_series=True, last_rows=None)
        b, _ = build_features_simple(p, leak_free=leak_free, encode=False, last_rows=None)
        assert by_id(a, cols) == by_id(b, cols)


def test_full_feature_set_split_equals_window(spark):
    import pytest
    from pricewise.operators.encode import build_features_full
    p = hot_prices(spark).withColumn("state", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("S"))
    a, _ = build_features_full(p, hot_series=True)
    b, _ = build_features_full(p)
    exact = ["price_lag_1", "price_lag_90", "price_rolling_mean_7", "price_rolling_mean_30", "market_code"]
    assert by_id(a, exact) == by_id(b, exact)
    sa, sb = by_id(a, ["price_rolling_std_7"]), by_id(b, ["price_rolling_std_7"])
    assert sa.keys() == sb.keys()
    for k in sa:
        assert sa[k][0] == pytest.approx(sb[k][0], rel=1e-9, abs=1e-9)


def test_means_from_running_sums(spark):
    """F8, F11, F13: no sliding frame, so a row costs the same for a mean of 7 or of 30 rows; the values stay exact."""
    from fractions import Fraction

    from pricewise.operators.encode import build_features_simple
    p = hot_prices(spark)
    d, _ = build_features_simple(p, leak_free=True, encode=False)
    assert "specifiedwindowframe(RowFrame, -30, -1)" not in d._jdf.queryExecution().optimizedPlan().toString()
    series = {}
    for r in p.orderBy("date", "id").collect():
        series.setdefault(r.market, []).append(r)
    at = {r.id: (rows[max(0, i - 30):i]) for rows in series.values() for i, r in enumerate(rows)}
    for r in d.collect():
        whole = [Fraction(x.modal_price) for x in at[r.id]]
        assert abs(r.price_ma_30 - float(sum(whole) / len(whole))) < 1e-9


def test_short_series_are_not_laid_out(spark, monkeypatch):
    """F8, F11: only series longer than a block take the range layout; both kinds give the same rows as the window."""
    laid = []
    positions = LS.series_positions
    monkeypatch.setattr(LS, "series_positions", lambda d, *a, **k: laid.append({r.market for r in d.select("market").distinct().collect()}) or positions(d, *a, **k))
    p = hot_prices(spark)
    want = by_id(S.lag_features(p, (1, 7)), ["price_lag_1", "price_lag_7"])
    assert by_id(LS.lag_split(p), ["price_lag_1", "price_lag_7"]) == want and laid == []
    assert by_id(LS.lag_split(p, block=100), ["price_lag_1", "price_lag_7"]) == want and laid == [{"HOT"}]


def test_features_with_dummies_are_computed_once(spark):
    """F8, F11, F13: the search for dummy values and the caller read a table, not the windows."""
    from pyspark.sql import functions as F

    from pricewise.operators.encode import build_features_simple
    p = hot_prices(spark).withColumns({"state": F.lit("S"), "variety": F.concat(F.lit("v"), (F.col("id") % 25).cast("string"))})
    d, names = build_features_simple(p)
    assert names == ["market_B", "market_HOT"]  # one state; 25 varieties are too many
    assert "Window" not in d._jdf.queryExecution().optimizedPlan().toString()
