"""Registered queries: models (survey 2.11).  Model fits have no SQL equivalent and get a
rows-only check, except one-feature OLS, which DuckDB's regr_slope / regr_intercept verify."""

from pyspark.sql import functions as F

from ..operators import encode as E
from ..operators import forecast as fc
from ..operators import ml as M
from ..operators.series import chrono_split
from ..session import stored
from ..sources.canonical import table
from ..sources.files import new_output_path
from .registry import query


def P(spark, sf):
    return table(spark, sf, "prices")


def _features(spark, sf):
    d, _ = E.build_features_simple(P(spark, sf).select("id", "date", "market", "state", "variety", "modal_price"), leak_free=True, encode=False)
    return d


def _with_dummies(spark, sf):
    """Features and dummies as the reference trains on: of market, state and variety those with fewer than 20 values."""
    d, names = E.build_features_simple(P(spark, sf).select("id", "date", "market", "state", "variety", "modal_price"), leak_free=True)
    return d, [*M.SIMPLE_FEATURES, *names]


def _split(spark, sf):
    s = stored(chrono_split(_features(spark, sf), 0.8), "split")
    return s.filter("is_train"), s.filter("NOT is_train")


@query("train_linear_one_feature", """
WITH f AS (SELECT modal_price AS y, lag(modal_price, 1) OVER (PARTITION BY market ORDER BY date, id) AS x FROM prices)
SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 4) AS intercept FROM f WHERE x IS NOT NULL""")
def q_train_linear_one_feature(spark, sf):
    from ..operators.series import lag_features
    d = lag_features(P(spark, sf), (1,)).na.drop(subset=["price_lag_1"])
    m = M.train_linear(d, ["price_lag_1"], scale=False)
    c = M.coefficients(m, ["price_lag_1"])
    return c.groupBy().agg(F.round(F.max(F.when(F.col("feature") == "price_lag_1", F.col("coefficient"))), 6).alias("slope"),
                           F.round(F.max(F.when(F.col("feature") == "intercept", F.col("coefficient"))), 4).alias("intercept"))


@query("train_linear")
def q_train_linear(spark, sf):
    # with the dummies of market, state and variety as one sparse vector, however many values these have
    tr = _split(spark, sf)[0]
    tr = E.one_hot_vectors(tr, E.one_hot_fit(tr))
    names = [*M.SIMPLE_FEATURES, "dummies"]
    return M.coefficients(M.train_linear(tr, names, scale=False), names)


@query("train_random_forest")
def q_train_random_forest(spark, sf):
    d, names = _with_dummies(spark, sf)
    return M.feature_importances(M.train_random_forest(chrono_split(d, 0.8).filter("is_train"), names), names)


@query("train_boosted_trees")
def q_train_boosted_trees(spark, sf):
    d, names = _with_dummies(spark, sf)
    return M.feature_importances(M.train_boosted_trees(chrono_split(d, 0.8).filter("is_train"), names), names)


@query("train_all")
def q_train_all(spark, sf):
    # the reference's parameters: forest 100 trees / depth 10 / leaf 2; boosting 100 rounds /
    # depth 6 / rate 0.05 / 0.8 sampling
    d, names = _with_dummies(spark, sf)
    return M.train_all(d, names)[1]


@query("train_seasonal")
def q_train_seasonal(spark, sf):
    return M.train_seasonal(P(spark, sf), horizon=30)


@query("least_squares_by_market", """
WITH d AS (SELECT market, ln(modal_price) AS y, date_diff('day', (SELECT min(date) FROM prices), date) / 365.25::DOUBLE AS t FROM prices)
SELECT market, count(*) AS n, round(regr_slope(y, t), 8) AS slope, round(regr_intercept(y, t), 7) AS intercept FROM d GROUP BY market""")
def q_least_squares_by_market(spark, sf):
    # the fit of the seasonal curves on two columns: log price over years, one line per market
    p = P(spark, sf)
    d = p.select("market", F.log("modal_price").alias("y"), (F.datediff("date", p.agg(F.min("date")).scalar()) / 365.25).alias("t"))
    return M.least_squares(d, ["t"], "y", ["market"]).select(
        "market", "n", F.round(F.get("coef", F.lit(1)), 8).alias("slope"), F.round(F.get("coef", F.lit(0)), 7).alias("intercept"))


@query("train_seasonal_by_market")
def q_train_seasonal_by_market(spark, sf):
    return M.train_seasonal(P(spark, sf), horizon=30, keys=["market"])


@query("forecast_recursive", """
WITH RECURSIVE f AS (
    SELECT modal_price AS y, lag(modal_price, 1) OVER w AS a, lag(modal_price, 7) OVER w AS b,
           avg(modal_price) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS c
    FROM prices WINDOW w AS (PARTITION BY market ORDER BY date, id)),
s AS (SELECT var_pop(a) AS aa, var_pop(b) AS bb, var_pop(c) AS cc, covar_pop(a, b) AS ab, covar_pop(a, c) AS ac, covar_pop(b, c) AS bc,
             covar_pop(a, y) AS ay, covar_pop(b, y) AS by_, covar_pop(c, y) AS cy, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, avg(y) AS my
      FROM f WHERE b IS NOT NULL),
d AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM s),
k AS MATERIALIZED (SELECT (ay * (bb * cc - bc * bc) - ab * (by_ * cc - bc * cy) + ac * (by_ * bc - bb * cy)) / det AS ka,
             (aa * (by_ * cc - bc * cy) - ay * (ab * cc - bc * ac) + ac * (ab * cy - by_ * ac)) / det AS kb,
             (aa * (bb * cy - by_ * bc) - ab * (ab * cy - by_ * ac) + ay * (ab * bc - bb * ac)) / det AS kc, ma, mb, mc, my FROM d),
t AS (SELECT market, date, id, modal_price, row_number() OVER (PARTITION BY market ORDER BY date DESC, id DESC) AS rn FROM prices),
h AS (SELECT market, count(*) AS n, list(modal_price ORDER BY date, id) AS hist FROM t WHERE rn <= 7 GROUP BY market),
path AS (SELECT market, 0 AS step, hist FROM h WHERE n >= 7
         UNION ALL
         SELECT market, step + 1, list_append(hist[2:7], my + ka * (hist[7] - ma) + kb * (hist[1] - mb) + kc * (list_sum(hist) / 7 - mc)) FROM path, k WHERE step < 30)
SELECT market, step - 1 AS step, round(hist[7], 3) AS predicted_price, CAST((SELECT max(date) FROM prices) + step AS DATE) AS date, 'ok' AS status
FROM path WHERE step > 0
UNION ALL SELECT market, NULL, NULL, NULL, 'insufficient' FROM h WHERE n < 7""")
def q_forecast_recursive(spark, sf):
    p = P(spark, sf)
    m = M.train_linear(M.recursive_training_frame(p), M.RECURSIVE_FEATURES)
    return M.forecast_recursive(m, p).withColumn("predicted_price", F.round("predicted_price", 3))


@query("forecast_recursive_trees")
def q_forecast_recursive_trees(spark, sf):
    # a model that is not linear: one transform over all markets for each step
    p = P(spark, sf)
    m = M.train_random_forest(M.recursive_training_frame(p), M.RECURSIVE_FEATURES, trees=20, depth=6)
    return M.forecast_recursive(m, p, horizon=7, checkpoint_every=4)


@query("save_load_model")
def q_save_load_model(spark, sf):
    tr, te = _split(spark, sf)
    path = M.save_model(M.train_linear(tr, M.SIMPLE_FEATURES, held=True), new_output_path(spark, "model"))
    return M.load_model(path).transform(te).select("id", "market", "prediction")


@query("forecast_7d_model")
def q_forecast_7d_model(spark, sf):
    # initial prediction from a trained model (leak-free features), then the damped path
    tr, _ = _split(spark, sf)
    m = M.train_linear(tr, M.SIMPLE_FEATURES, held=True)
    return fc.forecast_bands(fc.forecast_7d(P(spark, sf), model=m))


@query("one_hot_align", """
WITH t AS (SELECT market, arg_max(district, (date, id)) AS district, arg_max(variety, (date, id)) AS variety FROM prices GROUP BY market HAVING count(*) >= 7)
SELECT market, CAST(district = 'AMERICA' AS INTEGER) AS district_AMERICA, CAST(district = 'ASIA' AS INTEGER) AS district_ASIA,
       CAST(district = 'EUROPE' AS INTEGER) AS district_EUROPE, CAST(district = 'MIDDLE EAST' AS INTEGER) AS "district_MIDDLE EAST",
       CAST(variety = 'LARGE' AS INTEGER) AS variety_LARGE, CAST(variety = 'MEDIUM' AS INTEGER) AS variety_MEDIUM,
       CAST(variety = 'PROMO' AS INTEGER) AS variety_PROMO, CAST(variety = 'SMALL' AS INTEGER) AS variety_SMALL,
       CAST(variety = 'STANDARD' AS INTEGER) AS variety_STANDARD
FROM t""")
def q_one_hot_align(spark, sf):
    p = P(spark, sf)
    _, layout = E.one_hot(p, ("district", "variety"))
    latest = fc.latest_feature_row(p)
    return E.one_hot_align(latest, layout, ("district", "variety")).select("market", *layout)


@query("training_report")
def q_training_report(spark, sf):
    from ..operators.summary import training_report
    return training_report(P(spark, sf))
