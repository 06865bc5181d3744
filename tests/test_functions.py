import random

import numpy as np
from pyspark.sql import functions as F

from pricewise.functions import predicates as P
from pricewise.functions import scalars as X
from pricewise.operators import aggregates as A
from pricewise.operators import selection as S


def test_accuracy_bounds(spark):
    df = spark.createDataFrame([(100.0, 100.0), (90.0, 100.0), (100.0, 0.0), (None, 5.0)], "p double, a double")
    got = [r.acc for r in df.select(X.accuracy_pct("p", "a").alias("acc")).collect()]
    assert got == [100.0, 90.0, 0.0, 0.0]
    txt = [r.t for r in df.select(X.accuracy_text("p", "a").alias("t")).collect()]
    assert txt == ["100.0%", "90.0%", "", ""]


def test_contains_is_literal(spark):
    df = spark.createDataFrame([("50%_off",), ("500 off",)], "m string")
    assert [r.m for r in df.filter(P.contains("m", "0%_")).collect()] == ["50%_off"]
    assert df.filter(P.match("m", "All Markets")).count() == 2


def test_date_range_ignores_bad_text(spark):
    import datetime as dt
    df = spark.createDataFrame([(dt.date(2024, 1, d),) for d in range(1, 6)], "date date")
    assert df.filter(P.date_range("date", "2024-01-02", "garbage")).count() == 4


def test_season_and_lakh(spark):
    df = spark.createDataFrame([(m,) for m in range(1, 13)], "m int")
    assert [r.s for r in df.select(X.season("m").alias("s")).collect()] == [3, 3, 0, 0, 0, 1, 1, 1, 1, 2, 2, 3]
    v = spark.createDataFrame([(1234567.0,)], "v double").select(X.format_price_lakh("v").alias("t")).first().t
    assert v == "12,34,567"
    texts = [(1234567.89, "12,34,567.89"), (-1234.5, "-1,234.5"), (999.0, "999"), (0.1255, "0.126"), (100000.0, "1,00,000"), (None, None)]
    got = spark.createDataFrame([(a,) for a, _ in texts], "v double").select(X.format_price_lakh("v").alias("t")).collect()
    assert [r.t for r in got] == [t for _, t in texts]


def test_arithmetic_keeps_text(spark):
    df = spark.createDataFrame([("n/a", "2"), ("-3", "2"), ("-3", "x"), (None, "2")], "v string, a string")
    got = df.select(X.safe_subtract("v", "a", keep_text=True), X.safe_multiply("v", "a", keep_text=True), X.safe_abs("v", keep_text=True), X.safe_divide("v", "a")).collect()
    assert [tuple(r) for r in got] == [("n/a", "n/a", "n/a", 0.0), ("-5.0", "-6.0", "3.0", -1.5), ("-3", "-3", "3.0", 0.0), (None, None, None, 0.0)]


def test_exact_quantile_matches_numpy(spark):
    rnd = random.Random(7)
    vals = [float(rnd.randint(0, 500)) for _ in range(5001)] + [42.0] * 3000   # a hot value
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = df.select(A.exact_quantile(df, "x", 0.5).alias("m")).first().m
    assert got == float(np.median(vals))
    even = df.limit(4000)
    ev = [r.x for r in even.collect()]
    assert even.select(A.exact_quantile(even, "x", 0.5).alias("m")).first().m == float(np.median(ev))


def test_paginate_clamps(spark):
    df = spark.range(23).withColumnRenamed("id", "k")
    assert [r.k for r in S.paginate(df, [F.col("k")], 10, 99).collect()] == [20, 21, 22]
    assert [r.k for r in S.paginate(df, [F.col("k")], 10, "x").collect()] == list(range(10))


def test_profile_missing(spark):
    df = spark.createDataFrame([(1, None), (None, None)], "a int, b int")
    assert {r.column: r.missing for r in A.profile_missing(df).collect()} == {"a": 1, "b": 2}


def test_band_labels_follow_the_app(spark):
    df = spark.createDataFrame([(95.0,), (85.0,), (75.0,), (10.0,), (None,)], "x double")
    got = df.select(X.accuracy_band("x").alias("b"), X.accuracy_grade("x").alias("g"),
                    X.confidence_band("x").alias("c"), X.price_band("x").alias("p")).collect()
    assert [r.b for r in got] == ["bg-success", "bg-success", "bg-warning", "bg-danger", "bg-secondary"]
    assert [r.g for r in got] == ["Excellent", "Good", "Fair", "Poor", "Pending"]
    assert [r.c for r in got] == ["confidence-high", "confidence-high", "confidence-medium", "confidence-low", ""]
    assert [r.p for r in got] == ["price-high", "price-high", "price-high", "price-low", ""]
    col = spark.createDataFrame([(89.96,), (74.94,)], "x double").select(X.accuracy_color("x").alias("c"))
    assert [r.c for r in col.collect()] == ["green", "red"]
