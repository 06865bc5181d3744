"""Registered queries: per-series windows (survey 2.7) and feature encoding (2.11)."""

from pyspark.sql import functions as F

from ..operators import encode as E
from ..operators import series as S
from ..session import stored
from ..sources.canonical import table
from .registry import query
from .sqltext import mean, sround, window_mean

W = "WINDOW w AS (PARTITION BY market ORDER BY date, id)"


def P(spark, sf):
    return table(spark, sf, "prices")


@query("lag_features", f"""
SELECT id, market, date, modal_price, lag(modal_price, 1) OVER w AS price_lag_1, lag(modal_price, 7) OVER w AS price_lag_7,
       lag(modal_price, 30) OVER w AS price_lag_30, lag(modal_price, 90) OVER w AS price_lag_90
FROM prices {W}""")
def q_lag_features(spark, sf):
    return S.lag_features(P(spark, sf).select("id", "market", "date", "modal_price"), (1, 7, 30, 90))


@query("lag_features_pooled", f"""
WITH d AS (SELECT date, {mean("modal_price")} AS modal_price
           FROM prices GROUP BY date)
SELECT date, modal_price, lag(modal_price, 1) OVER (ORDER BY date) AS price_lag_1,
       lag(modal_price, 7) OVER (ORDER BY date) AS price_lag_7
FROM d""")
def q_lag_features_pooled(spark, sf):
    d = S.lag_features(S.pooled_daily(P(spark, sf)), (1, 7))
    return d.select("date", "modal_price", "price_lag_1", "price_lag_7")


@query("rolling_mean_partial", f"""
SELECT id, {window_mean('modal_price', 'w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW')} AS price_ma_7,
       {window_mean('modal_price', 'w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW')} AS price_ma_30
FROM prices {W}""")
def q_rolling_mean_partial(spark, sf):
    d = S.rolling_mean_partial(S.rolling_mean_partial(P(spark, sf), 7), 30)
    return d.select("id", "price_ma_7", "price_ma_30")


@query("rolling_mean_full", f"""
SELECT id,
  CASE WHEN count(modal_price) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) = 7
       THEN {window_mean('modal_price', 'w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW')} END AS price_rolling_mean_7,
  CASE WHEN count(modal_price) OVER (w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) = 30
       THEN {window_mean('modal_price', 'w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW')} END AS price_rolling_mean_30
FROM prices {W}""")
def q_rolling_mean_full(spark, sf):
    d = S.rolling_mean_full(S.rolling_mean_full(P(spark, sf), 7), 30)
    return d.select("id", "price_rolling_mean_7", "price_rolling_mean_30")


@query("rolling_std_full", f"""
SELECT id, CASE WHEN count(modal_price) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) = 7
       THEN {sround('stddev_samp(modal_price) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)', 4)} END AS price_rolling_std_7
FROM prices {W}""")
def q_rolling_std_full(spark, sf):
    d = S.rolling_std_full(P(spark, sf), 7)
    return d.select("id", F.round("price_rolling_std_7", 4).alias("price_rolling_std_7"))


@query("pct_change", f"""
SELECT id, {sround('(modal_price - lag(modal_price, 1) OVER w) / lag(modal_price, 1) OVER w', 10)} AS price_change_1,
       {sround('(modal_price - lag(modal_price, 7) OVER w) / lag(modal_price, 7) OVER w', 10)} AS price_change_7
FROM prices {W}""")
def q_pct_change(spark, sf):
    d = S.pct_change(S.pct_change(P(spark, sf), 1), 7)
    return d.select("id", F.round("price_change_1", 10).alias("price_change_1"),
                    F.round("price_change_7", 10).alias("price_change_7"))


TAIL = """t AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY date DESC, id DESC) AS rn FROM prices)"""


@query("tail_stats", f"""
WITH {TAIL}
SELECT market, min(modal_price) AS min_7, max(modal_price) AS max_7,
       {mean("modal_price")} AS avg_7,
       count(*) AS rows_7
FROM t WHERE rn <= 7 GROUP BY market""")
def q_tail_stats(spark, sf):
    return S.tail_stats(P(spark, sf), 7)


@query("nth_last_change", f"""
WITH {TAIL}
SELECT market, max(CASE WHEN rn = 1 THEN modal_price END) AS last_price, max(CASE WHEN rn = 8 THEN modal_price END) AS price_8_back,
       {sround('(max(CASE WHEN rn = 1 THEN modal_price END) - max(CASE WHEN rn = 8 THEN modal_price END)) / max(CASE WHEN rn = 8 THEN modal_price END) * 100', 6)} AS change_vs_8
FROM t WHERE rn <= 8 GROUP BY market""")
def q_nth_last_change(spark, sf):
    return S.nth_last_change(P(spark, sf), 8).withColumn("change_vs_8", F.round("change_vs_8", 6))


@query("chrono_split", """
SELECT id, market, row_number() OVER w <= floor(count(*) OVER (PARTITION BY market) * 0.8) AS is_train
FROM prices WINDOW w AS (PARTITION BY market ORDER BY date, id)""")
def q_chrono_split(spark, sf):
    return S.chrono_split(P(spark, sf), 0.8).select("id", "market", "is_train")


@query("chrono_split_pooled", """
WITH d AS (SELECT date, count(*) AS c FROM prices GROUP BY date),
cum AS (SELECT date, sum(c) OVER (ORDER BY date) AS cs FROM d),
cut AS (SELECT min(date) AS cd FROM cum WHERE cs >= (SELECT CAST(floor(count(*) * 0.8) AS BIGINT) FROM prices))
SELECT id, date < cd AS is_train FROM prices, cut""")
def q_chrono_split_pooled(spark, sf):
    return S.chrono_split_pooled(P(spark, sf), 0.8).select("id", "is_train")


@query("naive_baseline", f"""
SELECT id, market, modal_price, lag(modal_price, 1) OVER w AS prediction FROM prices {W}""")
def q_naive_baseline(spark, sf):
    return S.naive_baseline(P(spark, sf)).select("id", "market", "modal_price", "prediction")


@query("load_recent_window", """
SELECT date, market, state, district, variety, min_price, max_price, modal_price, arrival_quantity FROM prices
WHERE date >= CAST((SELECT max(date) FROM prices) - INTERVAL 730 DAY AS DATE)""")
def q_load_recent_window(spark, sf):
    return S.load_recent_window(P(spark, sf), None, 730,
                                ["date", "market", "state", "district", "variety", "min_price", "max_price",
                                 "modal_price", "arrival_quantity"])


# ----------------------------------------------------------------------------- encoding

@query("one_hot", """
SELECT id, CAST(district = 'AMERICA' AS INTEGER) AS district_AMERICA, CAST(district = 'ASIA' AS INTEGER) AS district_ASIA,
       CAST(district = 'EUROPE' AS INTEGER) AS district_EUROPE, CAST(district = 'MIDDLE EAST' AS INTEGER) AS "district_MIDDLE EAST",
       CAST(variety = 'LARGE' AS INTEGER) AS variety_LARGE, CAST(variety = 'MEDIUM' AS INTEGER) AS variety_MEDIUM,
       CAST(variety = 'PROMO' AS INTEGER) AS variety_PROMO, CAST(variety = 'SMALL' AS INTEGER) AS variety_SMALL,
       CAST(variety = 'STANDARD' AS INTEGER) AS variety_STANDARD
FROM prices""")
def q_one_hot(spark, sf):
    # region and part-type value sets are fixed by the data generator, so the oracle's columns
    # hold at every scale (market would cross the 20-value rule between scales)
    d, _ = E.one_hot(P(spark, sf).select("id", "district", "variety"), ("district", "variety"))
    return d


@query("one_hot_vectors", """
WITH c AS (SELECT id, dense_rank() OVER (ORDER BY market) - 1 AS m, dense_rank() OVER (ORDER BY state) - 1 AS s,
                  dense_rank() OVER (ORDER BY variety) - 1 AS v FROM prices),
n AS (SELECT max(m) AS m, max(s) AS s, max(v) AS v FROM c),
x AS (SELECT id, n.m + n.s + n.v AS size, list_filter([CASE WHEN c.m > 0 THEN c.m - 1 END, CASE WHEN c.s > 0 THEN n.m + c.s - 1 END,
                                                       CASE WHEN c.v > 0 THEN n.m + n.s + c.v - 1 END], lambda i: i IS NOT NULL) AS places FROM c, n)
SELECT id, '(' || size || ',[' || array_to_string(places, ',') || '],[' || array_to_string(list_transform(places, lambda i: '1.0'), ',') || '])' AS dummies FROM x""")
def q_one_hot_vectors(spark, sf):
    # market, state and variety, however many values they have, as one sparse vector (its text: size, places, ones)
    p = P(spark, sf).select("id", "market", "state", "variety")
    return E.one_hot_vectors(p, E.one_hot_fit(p)).select("id", F.col("dummies").cast("string").alias("dummies"))


@query("label_encode", """
SELECT id, CAST(dense_rank() OVER (ORDER BY market) - 1 AS INTEGER) AS market_code,
       CAST(dense_rank() OVER (ORDER BY state) - 1 AS INTEGER) AS state_code,
       CAST(dense_rank() OVER (ORDER BY district) - 1 AS INTEGER) AS district_code,
       CAST(dense_rank() OVER (ORDER BY variety) - 1 AS INTEGER) AS variety_code
FROM prices""")
def q_label_encode(spark, sf):
    d, _ = E.label_encode(P(spark, sf))
    return d.select("id", "market_code", "state_code", "district_code", "variety_code")


@query("standard_scale", f"""
WITH s AS MATERIALIZED (SELECT id, modal_price, arrival_quantity, row_number() OVER w <= floor(count(*) OVER (PARTITION BY market) * 0.8) AS is_train
           FROM prices WINDOW w AS (PARTITION BY market ORDER BY date, id)),
st AS MATERIALIZED (SELECT avg(modal_price) AS m1, stddev_pop(modal_price) AS s1, avg(arrival_quantity) AS m2,
              stddev_pop(arrival_quantity) AS s2 FROM s WHERE is_train)
SELECT id, {sround('(modal_price - m1) / s1', 6)} AS modal_price_scaled,
       {sround('(arrival_quantity - m2) / s2', 6)} AS arrival_quantity_scaled
FROM s, st WHERE NOT is_train""")
def q_standard_scale(spark, sf):
    # the split is written once: the fit and the scaled rows read it, the windows are planned once
    s = stored(S.chrono_split(P(spark, sf).select("id", "market", "date", "modal_price", "arrival_quantity"), 0.8), "split")
    out = E.standard_scale(s.filter("is_train"), s.filter("NOT is_train"), ["modal_price", "arrival_quantity"])
    return out.select("id", F.round("modal_price_scaled", 6).alias("modal_price_scaled"),
                      F.round("arrival_quantity_scaled", 6).alias("arrival_quantity_scaled"))


def _simple_sql(leak_free: bool) -> str:
    e = 1 if leak_free else 0
    src = "lag(modal_price, 1) OVER w" if leak_free else "modal_price"
    p1 = f"lag(modal_price, {2 if leak_free else 1}) OVER w"
    p7 = f"lag(modal_price, {8 if leak_free else 7}) OVER w"
    return f"""
WITH f AS (SELECT id, market, date, modal_price, CAST(dayofyear(date) AS INTEGER) AS day_of_year, CAST(month(date) AS INTEGER) AS month, CAST(year(date) AS INTEGER) AS year,
             lag(modal_price, 1) OVER w AS price_lag_1, lag(modal_price, 7) OVER w AS price_lag_7,
             {window_mean('modal_price', f'w ROWS BETWEEN {6 + e} PRECEDING AND {e} PRECEDING')} AS price_ma_7,
             {window_mean('modal_price', f'w ROWS BETWEEN {29 + e} PRECEDING AND {e} PRECEDING')} AS price_ma_30,
             ({src} - {p1}) / {p1} AS price_change_1, ({src} - {p7}) / {p7} AS price_change_7
      FROM prices WINDOW w AS (PARTITION BY market ORDER BY date, id))
SELECT id, market, date, modal_price, day_of_year, month, year, price_lag_1, price_lag_7,
       price_ma_7, price_ma_30,
       {sround('price_change_1', 10)} AS price_change_1, {sround('price_change_7', 10)} AS price_change_7
FROM f WHERE price_lag_1 IS NOT NULL AND price_lag_7 IS NOT NULL AND price_ma_7 IS NOT NULL AND price_ma_30 IS NOT NULL
  AND price_change_1 IS NOT NULL AND price_change_7 IS NOT NULL""".replace("PRECEDING AND 0 PRECEDING", "PRECEDING AND CURRENT ROW")


def _simple(spark, sf, leak_free):
    d, _ = E.build_features_simple(P(spark, sf).select("id", "market", "date", "modal_price"), leak_free=leak_free, encode=False)
    return d.select("id", "market", "date", "modal_price", "day_of_year", "month", "year", "price_lag_1",
                    "price_lag_7", "price_ma_7", "price_ma_30",
                    F.round("price_change_1", 10).alias("price_change_1"),
                    F.round("price_change_7", 10).alias("price_change_7"))


@query("build_features_simple", _simple_sql(False))
def q_build_features_simple(spark, sf):
    return _simple(spark, sf, False)


@query("build_features_simple_leak_free", _simple_sql(True))
def q_build_features_simple_leak_free(spark, sf):
    return _simple(spark, sf, True)


@query("build_features_full", f"""
WITH f AS (SELECT id, market, date, modal_price, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, CAST(day(date) AS INTEGER) AS day,
                  CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(dayofyear(date) AS INTEGER) AS day_of_year, CAST(weekofyear(date) AS INTEGER) AS week_of_year,
                  CAST(quarter(date) AS INTEGER) AS quarter,
                  CASE WHEN month(date) BETWEEN 3 AND 5 THEN 0 WHEN month(date) BETWEEN 6 AND 9 THEN 1
                       WHEN month(date) BETWEEN 10 AND 11 THEN 2 ELSE 3 END AS season,
                  lag(modal_price, 1) OVER w AS price_lag_1, lag(modal_price, 7) OVER w AS price_lag_7,
                  lag(modal_price, 30) OVER w AS price_lag_30, lag(modal_price, 90) OVER w AS price_lag_90,
                  CASE WHEN count(modal_price) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) = 7
                       THEN {window_mean('modal_price', 'w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW')} END AS m7,
                  CASE WHEN count(modal_price) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) = 7
                       THEN stddev_samp(modal_price) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) END AS s7,
                  CASE WHEN count(modal_price) OVER (w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) = 30
                       THEN {window_mean('modal_price', 'w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW')} END AS m30,
                  CAST(dense_rank() OVER (ORDER BY market) - 1 AS INTEGER) AS market_code,
                  CAST(dense_rank() OVER (ORDER BY state) - 1 AS INTEGER) AS state_code,
                  CAST(dense_rank() OVER (ORDER BY district) - 1 AS INTEGER) AS district_code,
                  CAST(dense_rank() OVER (ORDER BY variety) - 1 AS INTEGER) AS variety_code
           FROM prices WINDOW w AS (PARTITION BY market ORDER BY date, id))
SELECT id, market, date, modal_price, year, month, day, day_of_week, day_of_year, week_of_year, quarter, season,
       price_lag_1, price_lag_7, price_lag_30, price_lag_90, m7 AS price_rolling_mean_7,
       {sround('s7', 4)} AS price_rolling_std_7, m30 AS price_rolling_mean_30, market_code, state_code, district_code, variety_code
FROM f WHERE price_lag_90 IS NOT NULL AND price_lag_30 IS NOT NULL AND m7 IS NOT NULL AND s7 IS NOT NULL AND m30 IS NOT NULL""")
def q_build_features_full(spark, sf, hot_series=False):
    d, _ = E.build_features_full(P(spark, sf).select("id", "market", "state", "district", "variety", "date", "modal_price"), hot_series=hot_series)
    return d.select("id", "market", "date", "modal_price", "year", "month", "day", "day_of_week", "day_of_year",
                    "week_of_year", "quarter", "season", "price_lag_1", "price_lag_7", "price_lag_30", "price_lag_90",
                    "price_rolling_mean_7", F.round("price_rolling_std_7", 4).alias("price_rolling_std_7"),
                    "price_rolling_mean_30", "market_code", "state_code", "district_code", "variety_code")


# ----------------------------------------------------------------------------- long series
# The same features computed without a per-series window (see operators/long_series.py);
# they must give exactly the window results, so they share the oracles above.
from ..operators import long_series as LS  # noqa: E402
from .registry import _ORACLES  # noqa: E402


def _same_oracle(name, like):
    def deco(fn):
        return query(name, _ORACLES[like])(fn)
    return deco


@_same_oracle("lag_features_split", "lag_features")
def q_lag_features_split(spark, sf):
    return LS.lag_split(P(spark, sf).select("id", "market", "date", "modal_price"), (1, 7, 30, 90))


@query("rolling_mean_split", f"""
SELECT id, {window_mean('modal_price', 'w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW')} AS price_ma_7,
       CASE WHEN count(modal_price) OVER (w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) = 30
            THEN {window_mean('modal_price', 'w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW')} END AS price_rolling_mean_30
FROM prices {W}""")
def q_rolling_mean_split(spark, sf):
    # both means from one layout and one shuffle
    p = P(spark, sf).select("id", "market", "date", "modal_price")
    means = LS.in_blocks(p, 29, lambda d, k: S.rolling_mean_full(S.rolling_mean_partial(d, 7, keys=k), 30, keys=k))
    return means.select("id", "price_ma_7", "price_rolling_mean_30")


@query("pct_change_split", f"""
SELECT id, {sround('(modal_price - lag(modal_price, 7) OVER w) / lag(modal_price, 7) OVER w', 10)} AS price_change_7
FROM prices {W}""")
def q_pct_change_split(spark, sf):
    d = LS.pct_change_split(P(spark, sf).select("id", "market", "date", "modal_price"), 7)
    return d.select("id", F.round("price_change_7", 10).alias("price_change_7"))


@_same_oracle("chrono_split_split", "chrono_split")
def q_chrono_split_split(spark, sf):
    return LS.chrono_split_split(P(spark, sf), 0.8).select("id", "market", "is_train")


@query("history_guards", """
WITH h AS (SELECT * FROM prices WHERE date >= CAST((SELECT max(date) FROM prices) - INTERVAL 730 DAY AS DATE)),
t AS (SELECT count(*) AS total_rows FROM h)
SELECT market, count(*) AS rows,
       CASE WHEN count(*) < 7 THEN 'insufficient' WHEN count(*) < 15 THEN 'limited' ELSE 'ok' END AS status,
       (SELECT total_rows FROM t) AS total_rows, (SELECT total_rows FROM t) >= 30 AS enough_total
FROM h GROUP BY market""")
def q_history_guards(spark, sf):
    # guards apply to what the predictor loads: the 730 days before the last date
    return S.history_guards(S.load_recent_window(P(spark, sf)))


def _simple_hot(spark, sf, leak_free):
    d, _ = E.build_features_simple(P(spark, sf).select("id", "market", "date", "modal_price"), leak_free=leak_free, encode=False, hot_series=True)
    return d.select("id", "market", "date", "modal_price", "day_of_year", "month", "year", "price_lag_1",
                    "price_lag_7", "price_ma_7", "price_ma_30",
                    F.round("price_change_1", 10).alias("price_change_1"),
                    F.round("price_change_7", 10).alias("price_change_7"))


@_same_oracle("build_features_simple_split", "build_features_simple")
def q_build_features_simple_split(spark, sf):
    return _simple_hot(spark, sf, False)


@_same_oracle("build_features_simple_leak_free_split", "build_features_simple_leak_free")
def q_build_features_simple_leak_free_split(spark, sf):
    return _simple_hot(spark, sf, True)


@_same_oracle("label_encode_distributed", "label_encode")
def q_label_encode_distributed(spark, sf):
    d = E.join_codes(P(spark, sf), E.value_codes(P(spark, sf), ("market", "state", "district", "variety")))
    return d.select("id", "market_code", "state_code", "district_code", "variety_code")


@_same_oracle("build_features_full_split", "build_features_full")
def q_build_features_full_split(spark, sf):
    return q_build_features_full(spark, sf, True)


# ----------------------------------------------------------------------------- feature sets over all rows
# All rows of every market, with the dummies (their names, comma-joined, as the columns depend on the
# data) and all four label codes.

def _simple_all_sql(leak_free: bool) -> str:
    rows = _simple_sql(leak_free).replace("id, market, date, modal_price", "id, market, state, variety, date, modal_price")
    dummies = ", ".join(f"CASE WHEN (SELECT count(DISTINCT {c}) FROM g) < 20 AND {c} <> (SELECT min({c}) FROM g) THEN '{c}_' || {c} END"
                        for c in ("market", "state", "variety"))
    return f"WITH g AS ({rows}) SELECT *, concat_ws(',', {dummies}) AS dummies FROM g"


def _simple_all(spark, sf, leak_free, hot_series=False):
    d, names = E.build_features_simple(P(spark, sf).select("id", "market", "state", "variety", "date", "modal_price"),
                                       leak_free=leak_free, hot_series=hot_series)
    return d.select("id", "market", "state", "variety", "date", "modal_price", "day_of_year", "month", "year", "price_lag_1",
                    "price_lag_7", "price_ma_7", "price_ma_30",
                    F.round("price_change_1", 10).alias("price_change_1"), F.round("price_change_7", 10).alias("price_change_7"),
                    F.concat_ws(",", F.lit(None).cast("string"), *[F.when(F.col(f"`{n}`") == 1, F.lit(n)) for n in names]).alias("dummies"))


for _name, _leak_free in (("build_features_simple", False), ("build_features_simple_leak_free", True)):
    query(f"{_name}_all", _simple_all_sql(_leak_free))(lambda spark, sf, _l=_leak_free: _simple_all(spark, sf, _l))
    query(f"{_name}_all_split", _simple_all_sql(_leak_free))(lambda spark, sf, _l=_leak_free: _simple_all(spark, sf, _l, True))

query("build_features_full_all", _ORACLES["build_features_full"])(lambda spark, sf: q_build_features_full(spark, sf))
query("build_features_full_all_split", _ORACLES["build_features_full"])(lambda spark, sf: q_build_features_full(spark, sf, True))
