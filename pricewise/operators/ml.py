"""Model training, scoring and multi-step forecasting with Spark ML (survey 2.11).

Every model is a ``Pipeline`` (assembler -> scaler -> estimator), so the scaler fitted on the
training rows travels with the model and scoring can never use a different scaling.  Training
reads a feature DataFrame split chronologically per series; metrics are a distributed
aggregate over the test predictions.
"""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, StandardScalerModel, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, LinearRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from .aggregates import regression_metrics
from .series import KEYS, PRICE, _keys, as_of_column, chrono_split, exact_mean, price_sum, series_window, tail, usable

SIMPLE_FEATURES = ["day_of_year", "month", "year", "price_lag_1", "price_lag_7", "price_ma_7", "price_ma_30",
                   "price_change_1", "price_change_7"]


def _pipeline(features, estimator, scale: bool = True) -> Pipeline:
    stages = [VectorAssembler(inputCols=list(features), outputCol="raw_features", handleInvalid="keep")]
    if scale:
        stages.append(StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True))
    else:
        stages[0].setOutputCol("features")
    return Pipeline(stages=[*stages, estimator])


def _training_rows(train: DataFrame, features, label: str, held: bool) -> DataFrame:
    """The columns that a fit reads, written once (shared folder) for its passes unless the caller holds the rows in a
    table or cache: no executor memory is taken from the sorts and the fit."""
    rows = train.select(*dict.fromkeys([*features, label]))
    return rows if held or train.is_cached else stored(rows, "train")


def _in_few_parts(rows: DataFrame) -> DataFrame:
    """Rows for a tree fit.  Every part sends the statistics of all nodes of a level to the others, so there are as many
    parts as cores, and more only for parts over ``TREE_PART_ROWS``."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.coalesce(cores * max(1, math.ceil(rows.count() / (cores * TREE_PART_ROWS))))


def train_linear(train: DataFrame, features, label: str = PRICE, scale: bool = True, held: bool = False) -> PipelineModel:
    """Ordinary least squares (no regularisation) on scaled features.  Features may be vectors, such as the sparse
    dummies of ``encode.one_hot_vectors``: pass ``scale=False`` then, as centring would make them dense.

    Up to 4,096 columns the normal equations are solved; beyond that Spark ML minimises the same squares by L-BFGS
    over the sparse rows, as a matrix of columns x columns would not fit."""
    lr = LinearRegression(featuresCol="features", labelCol=label, regParam=0.0, elasticNetParam=0.0,
                          solver="auto", standardization=False)
    return _pipeline(features, lr, scale).fit(_training_rows(train, features, label, held))


# Per-task memory for a tree level's split statistics: smaller means more passes over the data
# but a bounded buffer per task, whatever the executor heap.
TREE_MEMORY_MB = 256
TREE_PART_ROWS = 1 << 22


def train_random_forest(train: DataFrame, features, label: str = PRICE, trees: int = 100, depth: int = 10,
                        min_leaf: int = 2, seed: int = 42, memory_mb: int = TREE_MEMORY_MB, held: bool = False) -> PipelineModel:
    rf = RandomForestRegressor(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth,
                               minInstancesPerNode=min_leaf, featureSubsetStrategy="all", seed=seed,
                               maxMemoryInMB=memory_mb)
    return _pipeline(features, rf, scale=False).fit(_in_few_parts(_training_rows(train, features, label, held)))


def train_boosted_trees(train: DataFrame, features, label: str = PRICE, rounds: int = 100, depth: int = 6,
                        rate: float = 0.05, subsample: float = 0.8, seed: int = 42,
                        memory_mb: int = TREE_MEMORY_MB, held: bool = False) -> PipelineModel:
    gbt = GBTRegressor(featuresCol="features", labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=rate,
                       subsamplingRate=subsample, featureSubsetStrategy=str(subsample), seed=seed,
                       maxMemoryInMB=memory_mb)
    return _pipeline(features, gbt, scale=False).fit(_in_few_parts(_training_rows(train, features, label, held)))


TRAINERS = {"lr": train_linear, "rf": train_random_forest, "xgb": train_boosted_trees}


def stored_split(features_df: DataFrame, features=SIMPLE_FEATURES, label: str = PRICE, frac: float = 0.8, keys=KEYS) -> DataFrame:
    """The features, the label and ``is_train`` of the chronological split, written once."""
    return stored(chrono_split(features_df, frac, keys).select(*dict.fromkeys([*features, label, "is_train"])), "train_split")


def train_all(features_df: DataFrame, features=SIMPLE_FEATURES, label: str = PRICE, frac: float = 0.8,
              keys=KEYS, models=("lr", "rf", "xgb"), held: bool = False, **params) -> tuple[dict[str, PipelineModel], DataFrame]:
    """Split each series chronologically, fit every model on the training rows and score the
    test rows.  Returns the fitted models and one metrics row per model.  The split is written
    once (shared folder; see ``stored_split``, or ``held`` if ``features_df`` is one); all fits and scores
    read that table, and nothing stays cached."""
    split = features_df if held else stored_split(features_df, features, label, frac, keys)
    train, test = split.filter("is_train"), split.filter("NOT is_train")
    fitted, metrics = {}, None
    for name in models:
        kw = params.get(name, {})
        m = TRAINERS[name](train, features, label, held=True, **kw)
        fitted[name] = m
        row = regression_metrics(m.transform(test), label, "prediction").withColumn("model", F.lit(name))
        metrics = row if metrics is None else metrics.unionByName(row)
    return fitted, metrics


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def coefficients(model: PipelineModel, features) -> DataFrame:
    """Coefficients of a fitted linear pipeline as rows (feature, coefficient) + intercept."""
    lr = model.stages[-1]
    spark = SparkSession.getActiveSession()
    values, plain = lr.coefficients.toArray(), len(features)
    names = list(features)
    if len(values) > plain:  # the last feature is a vector
        names = names[:-1] + [f"{names[-1]}[{i}]" for i in range(len(values) - plain + 1)]
    rows = [(f, float(c)) for f, c in zip(names, values)] + [("intercept", float(lr.intercept))]
    return spark.createDataFrame(rows, "feature string, coefficient double")


def feature_importances(model: PipelineModel, features) -> DataFrame:
    est = model.stages[-1]
    spark = SparkSession.getActiveSession()
    rows = [(f, float(v)) for f, v in zip(features, est.featureImportances.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double")


# ----------------------------------------------------------------------------- least squares by key

#: A column is left out (coefficient 0) if less than this share of its sum of squares is its own.
ALIASED = 1e-10


def least_squares(df: DataFrame, features, label: str, keys=(), **also: Column) -> DataFrame:
    """Ordinary least squares of every key in one job: keys, n, coef (array: intercept, then the features), sse,
    and the aggregates ``also``.

    One pass of partial sums of cross-products per key, so a hot key costs one row per task; then a sweep over the
    (features + 1) pivots of the normal equations, a fold over a fixed-size array in the JVM.  Columns that others
    determine (a dummy without rows, say) are left out in the order given.  Rows with a null or NaN value take no part.
    """
    ks = list(keys)
    x = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    y = F.col(label).cast("double")
    whole = F.lit(True)
    for c in (*x[1:], y):
        whole = whole & c.isNotNull() & ~F.isnan(c)
    k = len(x)
    sums = [F.sum(x[i] * x[j]).alias(f"_x{i}_{j}") for i in range(k) for j in range(i, k)]
    sums += [F.sum(c * y).alias(f"_y{i}") for i, c in enumerate(x)]
    g = df.filter(whole).groupBy(*ks).agg(F.count(F.lit(1)).alias("n"), F.sum(y * y).alias("_yy"), *sums,
                                          *[c.alias(name) for name, c in also.items()])
    rows = [F.array(*[F.col(f"_x{min(i, j)}_{max(i, j)}") for j in range(k)], F.col(f"_y{i}")) for i in range(k)]
    g = g.select(*ks, "n", "_yy", *also, F.array(*rows).alias("_m"), F.array(*[F.col(f"_y{i}") for i in range(k)]).alias("_xy"))

    def sweep(m, p):
        row, own = F.get(m, p), F.get(F.get(F.col("_m"), p), p)
        pivot = F.get(row, p)
        free = pivot > own * ALIASED
        return F.transform(m, lambda r, i: F.when(i == p, F.transform(row, lambda c: F.when(free, c / pivot).otherwise(F.lit(0.0))))
                           .when(free, F.zip_with(r, row, lambda a, b: a - F.get(r, p) / pivot * b)).otherwise(r))

    solved = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.col("_m"), sweep)
    g = g.withColumn("coef", F.transform(solved, lambda r: F.element_at(r, -1)))
    explained = F.aggregate(F.zip_with("coef", "_xy", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return g.select(*ks, "n", "coef", F.greatest(F.col("_yy") - explained, F.lit(0.0)).alias("sse"), *also)


def linear_value(coef: Column | str, features) -> Column:
    """Intercept + coefficients x features, for the ``coef`` of ``least_squares``."""
    out = F.get(coef, F.lit(0))
    for i, f in enumerate(features):
        out = out + F.get(coef, F.lit(i + 1)) * F.col(f)
    return out


# ----------------------------------------------------------------------------- seasonal model

# The festival dates the app lists, each widened by +/- 2 days.
DEFAULT_HOLIDAYS = ["2023-01-26", "2023-03-08", "2023-04-14", "2023-08-15", "2023-10-02", "2023-12-25"]
HOLIDAY_WINDOW = 2
FOURIER_ORDER = 3
YEAR_DAYS = 365.25


def seasonal_design(df: DataFrame, holidays: DataFrame, origin_col: str = "origin") -> DataFrame:
    """Trend, yearly Fourier terms, weekday dummies and a holiday flag per row (by date).

    ``holidays`` has one ``date`` column; a row is a holiday when its month-day is within the
    window of a listed month-day (the list repeats every year).  The list is a small literal
    table, so it is broadcast.
    """
    t = F.datediff("date", F.col(origin_col)).cast("double")
    doy = F.dayofyear("date").cast("double")
    cols = {"t": t / YEAR_DAYS}
    for k in range(1, FOURIER_ORDER + 1):
        cols[f"sin{k}"] = F.sin(2 * math.pi * k * doy / YEAR_DAYS)
        cols[f"cos{k}"] = F.cos(2 * math.pi * k * doy / YEAR_DAYS)
    for d in range(1, 7):
        cols[f"dow{d}"] = (F.weekday("date") == d).cast("double")
    out = df.withColumns(cols)
    hol = (holidays.select(F.explode(F.sequence(F.date_sub("date", HOLIDAY_WINDOW), F.date_add("date", HOLIDAY_WINDOW)))
                           .alias("d"))
           .select(F.date_format("d", "MM-dd").alias("_md")).distinct().withColumn("holiday", F.lit(1.0)))
    out = out.withColumn("_md", F.date_format("date", "MM-dd")).join(F.broadcast(hol), "_md", "left")
    return out.withColumn("holiday", F.coalesce("holiday", F.lit(0.0))).drop("_md")


SEASONAL_FEATURES = ["t"] + [f"{f}{k}" for k in range(1, FOURIER_ORDER + 1) for f in ("sin", "cos")] + \
    [f"dow{d}" for d in range(1, 7)] + ["holiday"]


def seasonal_by_key(prices: DataFrame, holidays: DataFrame, horizon: int, z: float, price_col: str, keys) -> DataFrame:
    """One curve per key, all fitted by ``least_squares`` in one pass over the daily means (a key has at most one row
    per day).  A key needs a usable, positive price on two days; below that it has no row, as no spread exists."""
    ks = _keys(keys)
    daily = (prices.groupBy(*ks, "date").agg(price_sum(price_col).alias("_s"), F.count(usable(price_col)).alias("_n"))
             .withColumn("_mean", exact_mean("_s", "_n")).filter(F.col("_mean") > 0)
             .select(*ks, "date", F.log("_mean").alias("y")))
    origin = prices.agg(F.min("date")).scalar()
    hist = seasonal_design(daily.withColumn("origin", origin), holidays)
    fit = least_squares(hist, SEASONAL_FEATURES, "y", ks, last=F.max("date")).filter("n > 1")
    days = fit.select(*ks, "coef", F.sqrt(F.col("sse") / (F.col("n") - 1)).alias("sd"),
                      F.explode(F.sequence(F.date_add("last", 1), F.date_add("last", horizon))).alias("date"))
    out = seasonal_design(days.withColumn("origin", origin), holidays).withColumn("_fit", linear_value("coef", SEASONAL_FEATURES))
    return out.select(*ks, F.col("date").alias("ds"), F.exp("_fit").alias("yhat"), F.exp(F.col("_fit") - F.lit(z) * F.col("sd")).alias("yhat_lower"),
                      F.exp(F.col("_fit") + F.lit(z) * F.col("sd")).alias("yhat_upper"))


def train_seasonal(prices: DataFrame, holidays: DataFrame | None = None, horizon: int = 30, z: float = 1.2816,
                   price_col: str = PRICE, keys=None) -> DataFrame:
    """Additive regression on log(price) over daily mean prices (trend + yearly Fourier
    terms + weekday + holidays), i.e. multiplicative seasonality on the price scale: of the pooled
    series, or with ``keys`` one curve for every key (see ``seasonal_by_key``).

    Returns ``horizon`` future days: (keys,) ds, yhat, yhat_lower, yhat_upper
    (an 80 % band from the residual spread).
    """
    from .series import pooled_daily
    spark = prices.sparkSession
    if holidays is None:
        holidays = spark.createDataFrame([(d,) for d in DEFAULT_HOLIDAYS], "date string").select(
            F.col("date").cast("date").alias("date"))
    if keys:
        return seasonal_by_key(prices, holidays, horizon, z, price_col, keys)
    daily = pooled_daily(prices, price_col).select("date", F.log(price_col).alias("y"))
    bounds = daily.agg(F.min("date").alias("origin"), F.max("date").alias("last"))
    origin = bounds.select("origin").scalar()
    hist = seasonal_design(daily.withColumn("origin", origin), holidays)
    model = train_linear(hist, SEASONAL_FEATURES, "y", scale=False)
    fitted = model.transform(hist)
    sd = fitted.agg(F.stddev_samp(F.col("y") - F.col("prediction"))).scalar()
    last = bounds.select("last").scalar()
    future = (daily.limit(1).select(F.explode(F.sequence(F.date_add(last, 1), F.date_add(last, horizon))).alias("date"))
              .withColumn("origin", origin))
    pred = model.transform(seasonal_design(future, holidays))
    yhat = F.exp("prediction")
    return pred.select(F.col("date").alias("ds"), yhat.alias("yhat"),
                       F.exp(F.col("prediction") - F.lit(z) * sd).alias("yhat_lower"),
                       F.exp(F.col("prediction") + F.lit(z) * sd).alias("yhat_upper"))


# ----------------------------------------------------------------------------- recursive forecast

RECURSIVE_FEATURES = ["price_lag_1", "price_lag_7", "price_ma_7"]
RECURSIVE_ROWS = 7


def recursive_training_frame(prices: DataFrame, keys=KEYS, price_col: str = PRICE) -> DataFrame:
    """Leak-free rows for the recursive model: the previous row, the row 7 back and the mean
    of the 7 previous rows predict the current price."""
    w = series_window(keys)
    return (prices.select(*_keys(keys), "date", "id", price_col)
            .withColumns({"price_lag_1": F.lag(price_col, 1).over(w), "price_lag_7": F.lag(price_col, 7).over(w),
                          "price_ma_7": F.avg(price_col).over(w.rowsBetween(-7, -1))})
            .na.drop(subset=RECURSIVE_FEATURES))


def linear_terms(model: PipelineModel) -> tuple[float, list[float]] | None:
    """(intercept, coefficients) of a fitted linear pipeline on its unscaled features; None for other models."""
    last = model.stages[-1]
    if not isinstance(last, LinearRegressionModel):
        return None
    intercept, coef = float(last.intercept), [float(c) for c in last.coefficients.toArray()]
    for stage in model.stages[:-1]:
        if isinstance(stage, StandardScalerModel):
            mean, std = stage.mean.toArray(), stage.std.toArray()
            coef = [c / s if s else 0.0 for c, s in zip(coef, std)]
            intercept -= sum(c * m for c, m in zip(coef, mean))
    return intercept, coef


def _recursive_features(hist: Column) -> list[Column]:
    """RECURSIVE_FEATURES from an array of a series' prices, oldest first."""
    week = F.aggregate(F.slice(hist, -RECURSIVE_ROWS, RECURSIVE_ROWS), F.lit(0.0), lambda a, x: a + x) / RECURSIVE_ROWS
    return [F.try_element_at(hist, F.lit(-1)), F.try_element_at(hist, F.lit(-RECURSIVE_ROWS)), week]


def forecast_recursive(model: PipelineModel, prices: DataFrame, horizon: int = 30, keys=KEYS,
                       price_col: str = PRICE, checkpoint_every: int = 10, as_of=None) -> DataFrame:
    """Multi-step forecast for every series: predict, feed the prediction back as the newest
    price, repeat ``horizon`` times.  Dates count from ``as_of`` + 1 (default: the table's last day)
    for every series; later rows are not read.

    State per series is the array of its newest 7 prices, as far as the features look back (taken
    with a WindowGroupLimit).  A linear model's steps are one fold over that array in the
    JVM: no job per step.  For other models the driver loops over *steps*, never rows: each step is one
    ``model.transform`` over all series, and lineage is cut with a reliable ``checkpoint`` (in
    the shared ``spark.checkpoint.dir``) every ``checkpoint_every`` steps, so a lost executor
    recomputes at most that many steps.

    Forecast rows have status 'ok'.  A series with fewer than the 7 rows that the features look
    back gives one row with status 'insufficient' and null step, price and date.
    """
    ks = _keys(keys)
    a = as_of_column(prices, as_of)
    if as_of is not None:
        prices = prices.filter(F.col("date") <= a)
    state = (tail(prices, RECURSIVE_ROWS, ks, price_col).groupBy(*ks)
             .agg(F.array_sort(F.collect_list(F.struct(F.col("_rn").alias("rn"), F.col(price_col).alias("p"))))
                  .alias("_t"))
             .select(*ks, F.reverse(F.transform("_t", lambda x: x["p"].cast("double"))).alias("hist")))
    short = state.filter(F.size("hist") < RECURSIVE_ROWS)
    state = state.filter(F.size("hist") >= RECURSIVE_ROWS)
    terms = linear_terms(model)
    if terms is not None:
        intercept, coef = terms

        def step(hist, _):
            p = F.lit(intercept)
            for c, x in zip(coef, _recursive_features(hist)):
                p = p + F.lit(c) * x
            return F.concat(hist, F.array(p))

        grown = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.col("hist"), step)
        state = state.select(*ks, F.slice(grown, RECURSIVE_ROWS + 1, horizon).alias("path"))
    else:
        state = state.withColumn("path", F.array().cast("array<double>"))
        for n in range(1, horizon + 1):
            feats = state.withColumns(dict(zip(RECURSIVE_FEATURES, _recursive_features(F.col("hist")))))
            state = model.transform(feats).select(
                *ks, F.slice(F.concat("hist", F.array("prediction")), -RECURSIVE_ROWS, RECURSIVE_ROWS).alias("hist"),
                F.concat("path", F.array("prediction")).alias("path"))
            if checkpoint_every and n % checkpoint_every == 0 and n < horizon:
                state = state.checkpoint(eager=True)
    out = state.select(*ks, F.posexplode("path").alias("step", "predicted_price")) \
        .withColumn("date", F.date_add(a, F.col("step") + 1)).withColumn("status", F.lit("ok"))
    return out.unionByName(short.select(*ks, F.lit(None).cast("int").alias("step"), F.lit(None).cast("double").alias("predicted_price"),
                                        F.lit(None).cast("date").alias("date"), F.lit("insufficient").alias("status")))
