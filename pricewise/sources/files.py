"""Reads and writes (survey 2.1): table scans, CSV upload/export, JSON payloads, prediction sink.

Every sink writes under the shared folder (``spark.checkpoint.dir``) or a caller-given path,
with Spark's committer (a failed task is retried, a failed job leaves no partial output).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.scalars import accuracy_text
from ..schemas import PRICE_REQUIRED, PRICES_CSV_TEXT
from ..session import shared_path, shuffles_dropped


def scan(spark: SparkSession, path: str, schema=None, fmt: str = "parquet", **options) -> DataFrame:
    """Full scan of a stored table (parquet by default; ``fmt='jdbc'`` with options works too)."""
    r = spark.read.format(fmt).options(**options)
    if schema is not None:
        r = r.schema(schema)
    return r.load(path) if path else r.load()


def read_prices_csv(spark: SparkSession, path: str, with_row_numbers: bool = True) -> DataFrame:
    """Uploaded price file as text columns (+ ``file_row``, 0-based line after the header).

    Raises ValueError listing required columns missing from the header, before any action on
    the data.  Cells stay text so that bad values become reject reasons, not job failures.
    """
    # No user schema: with one, the CSV reader assigns columns by position, and an upload with
    # its columns in another order would be misread.  Without one every column is text, named
    # by the header, and selected by name.
    raw = spark.read.option("header", True).option("inferSchema", False).option("mode", "PERMISSIVE").csv(path)
    missing = [c for c in PRICE_REQUIRED if c not in raw.columns]
    if missing:
        raise ValueError(f"Missing required columns: {', '.join(missing)}")
    df = raw.select(*[F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c)
                      for c in PRICES_CSV_TEXT.fieldNames() if c != "_corrupt"])
    if with_row_numbers:
        df = number_rows(df)
    return df


def number_rows(df: DataFrame, name: str = "file_row", file_name: str = "source_file") -> DataFrame:
    """Exact 0-based line number of every row within its own input file (after the header).

    A piece is the part of a file that starts at one byte place (an input split).  Rows get a
    monotonically increasing id, consecutive inside a piece; the rows of the pieces before a
    piece, a running sum over its file's pieces by byte place, are its offset:
    line = offset + (id - first id of the piece).  All in one plan: one extra pass that counts
    rows per piece, nothing on the driver, no window over the rows of a file.
    """
    place = ["_file", "_start"]
    tagged = df.withColumns({file_name: F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start"),
                             "_mid": F.monotonically_increasing_id()})
    before = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (tagged.groupBy(F.col(file_name).alias("_file"), "_start").agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
              .withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    # one row per input split: Spark's size check decides whether to broadcast it
    return (tagged.withColumn("_file", F.col(file_name)).join(pieces, place)
            .withColumn(name, F.col("_base") + F.col("_mid") - F.col("_first"))
            .drop(*place, "_mid", "_first", "_base"))


def parse_dates(df: DataFrame, col: str = "date") -> DataFrame:
    """Text -> DATE; unparseable text becomes null (ANSI would otherwise fail the job)."""
    return df.withColumn(col, F.col(col).cast("string").try_cast("date"))


def get_price_data(prices: DataFrame, start=None, end=None, market=None) -> DataFrame:
    """Range + equality find, ascending by date, without the storage id."""
    return (prices.filter(P.date_range("date", start, end) & P.exact("market", market))
            .orderBy("date", "id").drop("id"))


def get_recent_prices(prices: DataFrame, as_of=None, days: int = 30, limit: int = 100) -> DataFrame:
    from ..operators.series import as_of_column
    a = as_of_column(prices, as_of)
    return prices.filter(F.col("date") >= F.date_sub(a, days)).orderBy(F.col("date").desc(), F.col("id").desc()).limit(limit)


def append_prices(target: DataFrame, source: DataFrame) -> DataFrame:
    """Unvalidated append; missing ``arrival_quantity`` becomes 0."""
    src = source
    if "arrival_quantity" not in src.columns:
        src = src.withColumn("arrival_quantity", F.lit(0.0))
    src = src.withColumn("arrival_quantity", F.coalesce(F.col("arrival_quantity").cast("double"), F.lit(0.0)))
    return target.unionByName(src.select(*[c for c in target.columns if c in src.columns]), allowMissingColumns=True)


def to_prediction_rows(forecast: DataFrame, as_of, model_id=None) -> DataFrame:
    """Forecast rows in the predictions table layout: modal, min x0.95, max x1.05 (unrounded,
    as the app stores them), confidence schedule x100 (the app saved a constant 85)."""
    a = F.lit(as_of).cast("date") if not hasattr(as_of, "alias") else as_of
    p = F.col("predicted_price")
    return forecast.select(
        a.alias("prediction_date"), F.col("date").alias("forecast_date"), "market",
        (p * 0.95).alias("predicted_min_price"), (p * 1.05).alias("predicted_max_price"),
        p.alias("predicted_modal_price"),
        F.round((F.lit(0.85) - F.lit(0.05) * F.col("step")) * 100, 2).alias("confidence_interval"),
        F.lit(model_id).cast("long").alias("model_used_id"), F.lit(None).cast("double").alias("actual_price"))


def save_predictions(forecast: DataFrame, as_of, path: str, model_id=None) -> str:
    """Append forecast rows to the predictions table, partitioned by prediction date."""
    to_prediction_rows(forecast, as_of, model_id).write.mode("append").partitionBy("prediction_date").parquet(path)
    return path


PRICE_EXPORT = ["date", "market", "state", "district", "variety", "min_price", "max_price", "modal_price",
                "arrival_quantity"]


def export_prices_csv(prices: DataFrame, path: str, market=None, state=None, start=None, end=None, compression: str = "none") -> str:
    """Filtered prices, newest first, the 9 upload columns, with header; plain text unless ``compression`` names a codec."""
    out = (prices.filter(P.contains("market", market) & P.contains("state", state) & P.date_range("date", start, end))
           .orderBy(F.col("date").desc(), F.col("id").desc()).select(*PRICE_EXPORT))
    with shuffles_dropped(prices.sparkSession):
        out.write.mode("overwrite").option("header", True).option("compression", compression).csv(path)
    return path


def _prediction_filters(predictions: DataFrame, market=None, start=None, end=None, confidence=None) -> DataFrame:
    return predictions.filter(P.contains("market", market) & P.date_range("forecast_date", start, end)
                              & P.confidence("confidence_interval", confidence or ""))


def prediction_export_frame(predictions: DataFrame, models: DataFrame, **filters) -> DataFrame:
    """The 11 export columns; missing actual price / model become ''."""
    from ..operators.selection import join_prediction_model
    j = join_prediction_model(_prediction_filters(predictions, **filters), models)
    return j.orderBy(F.col("forecast_date").desc(), F.col("id").desc()).select(
        "id", "prediction_date", "forecast_date", "market", "predicted_min_price", "predicted_modal_price",
        "predicted_max_price", "confidence_interval",
        F.coalesce(F.nullif(F.col("actual_price"), F.lit(0.0)).cast("string"), F.lit("")).alias("actual_price"),
        F.coalesce("model_name", F.lit("")).alias("model_used"), "created_at")


def export_predictions_csv(predictions: DataFrame, models: DataFrame, path: str, **filters) -> str:
    prediction_export_frame(predictions, models, **filters).write.mode("overwrite").option("header", True).csv(path)
    return path


# Display headers of the prediction report.
REPORT_HEADERS = ["ID", "Prediction Date", "Forecast Date", "Market", "Min Price (₹)", "Modal Price (₹)",
                  "Max Price (₹)", "Confidence (%)", "Actual Price (₹)", "Model Used", "Accuracy"]


def prediction_report_frame(predictions: DataFrame, models: DataFrame, **filters) -> DataFrame:
    from ..operators.selection import join_prediction_model
    j = join_prediction_model(_prediction_filters(predictions, **filters), models)
    cols = [F.col("id"), F.col("prediction_date"), F.col("forecast_date"), F.col("market"),
            F.col("predicted_min_price"), F.col("predicted_modal_price"), F.col("predicted_max_price"),
            F.col("confidence_interval"), F.col("actual_price"), F.coalesce("model_name", F.lit("N/A")),
            accuracy_text("predicted_modal_price", "actual_price")]
    return j.orderBy(F.col("forecast_date").desc(), F.col("id").desc()).select(
        *[c.alias(h) for c, h in zip(cols, REPORT_HEADERS)])


def export_predictions_report(predictions: DataFrame, models: DataFrame, path: str, **filters) -> str:
    """Display-named columns with the accuracy text (a CSV; no workbook writer is used)."""
    prediction_report_frame(predictions, models, **filters).write.mode("overwrite").option("header", True).csv(path)
    return path


def prediction_status_frame(predictions: DataFrame) -> DataFrame:
    a = F.col("actual_price")
    return predictions.select(
        "id", "market", "forecast_date", "predicted_min_price", "predicted_modal_price", "predicted_max_price",
        "confidence_interval", "actual_price", accuracy_text("predicted_modal_price", "actual_price").alias("accuracy"),
        F.when(a.isNotNull() & (a != 0), "Verified").otherwise("Pending").alias("status"))


def export_predictions_status(predictions: DataFrame, path: str) -> str:
    prediction_status_frame(predictions).write.mode("overwrite").option("header", True).csv(path)
    return path


def prices_json(prices: DataFrame, as_of=None, days: int = 60, market=None) -> DataFrame:
    """One JSON object per row for the last ``days`` days (ascending; null prices -> 0)."""
    from ..operators.series import as_of_column
    a = as_of_column(prices, as_of)
    rows = prices.filter((F.col("date") >= F.date_sub(a, days)) & (F.col("date") <= a) & P.iexact("market", market))
    obj = F.struct(F.date_format("date", "yyyy-MM-dd").alias("date"), F.col("market"),
                   *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("modal_price", "min_price", "max_price")])
    return rows.select("id", "date", F.to_json(obj).alias("json"))


def prediction_json(forecast: DataFrame, pct: float = 0.05) -> DataFrame:
    """{date, predicted_price, lower_bound, upper_bound}; bounds default to -/+ 5 %."""
    p = F.col("predicted_price")
    lo = F.col("lower") if "lower" in forecast.columns else p * (1 - pct)
    hi = F.col("upper") if "upper" in forecast.columns else p * (1 + pct)
    obj = F.struct(F.date_format("date", "yyyy-MM-dd").alias("date"), p.alias("predicted_price"),
                   lo.alias("lower_bound"), hi.alias("upper_bound"))
    return forecast.select("market", "step", F.to_json(obj).alias("json"))


def new_output_path(spark: SparkSession, name: str) -> str:
    return shared_path(spark, "pricewise-out", name, unique=True)
