"""Declared schemas of the canonical tables, required columns and enumerations."""

from pyspark.sql import types as T

PRICES = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("date", T.DateType()),
    T.StructField("market", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("district", T.StringType()),
    T.StructField("variety", T.StringType()),
    T.StructField("min_price", T.DoubleType()),
    T.StructField("max_price", T.DoubleType()),
    T.StructField("modal_price", T.DoubleType()),
    T.StructField("arrival_quantity", T.DoubleType()),
])

# Columns an uploaded price file must carry (arrival_quantity is optional, default 0).
PRICE_REQUIRED = ["date", "market", "state", "district", "variety", "min_price", "max_price", "modal_price"]
PRICE_COLUMNS = PRICE_REQUIRED + ["arrival_quantity"]

# CSV uploads are read as text first so that bad cells become reasons, not job failures.
PRICES_CSV_TEXT = T.StructType([T.StructField(c, T.StringType()) for c in PRICE_COLUMNS]
                               + [T.StructField("_corrupt", T.StringType())])

PREDICTIONS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("prediction_date", T.DateType()),
    T.StructField("forecast_date", T.DateType()),
    T.StructField("market", T.StringType()),
    T.StructField("predicted_min_price", T.DoubleType()),
    T.StructField("predicted_max_price", T.DoubleType()),
    T.StructField("predicted_modal_price", T.DoubleType()),
    T.StructField("confidence_interval", T.DoubleType()),
    T.StructField("model_used_id", T.LongType()),
    T.StructField("actual_price", T.DoubleType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

MODELS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("model_type", T.StringType()),
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("mse", T.DoubleType()),
    T.StructField("mae", T.DoubleType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("is_active", T.BooleanType()),
])

FACTORS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("factor_type", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("impact_score", T.DoubleType()),
    T.StructField("is_active", T.BooleanType()),
])

WEATHER = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("date", T.DateType()),
    T.StructField("district", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("rainfall", T.DoubleType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("humidity", T.DoubleType()),
])

# Enumerations of the data model.
MODEL_TYPES = ["LSTM", "RF", "XGB", "PROPHET"]
FACTOR_TYPES = ["SEASONAL", "WEATHER", "ECONOMIC", "POLICY", "TRANSPORT"]
USER_TYPES = ["FARMER", "TRADER", "CONSUMER", "GOVERNMENT", "RESEARCHER"]
