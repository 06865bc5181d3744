"""Registered queries: scans, sources and sinks (survey 2.1).  Sinks are checked by reading
back what they wrote (into a fresh folder under the shared checkpoint folder)."""

from pyspark.sql import functions as F

from ..operators import forecast as fc
from ..schemas import PRICES
from ..sources import files as IO
from ..sources.canonical import materialize, table
from .q_forecast import forecast_sql
from .registry import query
from .sqltext import AS_OF_PRICES, sround


def T(spark, sf, name):
    return table(spark, sf, name)


PRICE_COLS = "id, date, market, state, district, variety, min_price, max_price, modal_price, arrival_quantity"


@query("scan_prices", f"SELECT {PRICE_COLS} FROM prices")
def q_scan_prices(spark, sf):
    return IO.scan(spark, materialize(spark, sf, ["prices"])["prices"], PRICES)


# (the four-row models literal is only ever read through joins with predictions)
for _name in ("predictions", "factors", "users", "profiles", "messages"):
    def _scan(spark, sf, _n=_name):
        return IO.scan(spark, materialize(spark, sf, [_n])[_n])
    query(f"scan_{_name}", f"SELECT * FROM {_name}")(_scan)


def _csv_round_trip(spark, sf):
    # export everything -> read the upload back -> validate: the CSV round trip loses nothing
    from ..operators.quality import validate_prices
    path = IO.export_prices_csv(T(spark, sf, "prices"), IO.new_output_path(spark, "prices_csv"))
    v = validate_prices(IO.read_prices_csv(spark, path))
    return v.select("date", "market", "state", "district", "variety", "min_price", "max_price", "modal_price",
                    "arrival_quantity")


@query("read_prices_csv", """
SELECT date, market, state, district, variety, min_price, max_price, modal_price, arrival_quantity
FROM prices""")
def q_read_prices_csv(spark, sf):
    return _csv_round_trip(spark, sf)


@query("read_prices_csv_all", """
SELECT date, market, state, district, variety, min_price, max_price, modal_price, arrival_quantity
FROM prices""")
def q_read_prices_csv_all(spark, sf):
    return _csv_round_trip(spark, sf)


@query("parse_dates", """
SELECT id, TRY_CAST(CASE WHEN id % 10 = 0 THEN 'bad-' || CAST(date AS VARCHAR) ELSE CAST(date AS VARCHAR) END AS DATE) AS date
FROM prices""")
def q_parse_dates(spark, sf):
    p = T(spark, sf, "prices")
    txt = F.when(F.col("id") % 10 == 0, F.concat(F.lit("bad-"), F.col("date").cast("string"))).otherwise(
        F.col("date").cast("string"))
    return IO.parse_dates(p.select("id", txt.alias("date")))


@query("get_price_data", """
SELECT date, market, state, district, variety, min_price, max_price, modal_price, arrival_quantity FROM prices
WHERE date BETWEEN DATE '1998-01-01' AND DATE '1999-12-31' AND market = 'Supplier#000000042' ORDER BY date""")
def q_get_price_data(spark, sf):
    return IO.get_price_data(T(spark, sf, "prices"), "1998-01-01", "1999-12-31", "Supplier#000000042")


@query("get_recent_prices", f"""
SELECT {PRICE_COLS} FROM prices WHERE date >= CAST({AS_OF_PRICES} - INTERVAL 30 DAY AS DATE)
ORDER BY date DESC, id DESC LIMIT 100""")
def q_get_recent_prices(spark, sf):
    return IO.get_recent_prices(T(spark, sf, "prices"))


@query("append_prices", f"""
SELECT {PRICE_COLS} FROM prices
UNION ALL
SELECT id + 100000, CAST(date + INTERVAL 1 DAY AS DATE), market, state, district, variety, min_price, max_price,
       modal_price, 0.0 FROM prices WHERE date >= CAST({AS_OF_PRICES} - INTERVAL 10 DAY AS DATE)""")
def q_append_prices(spark, sf):
    p = T(spark, sf, "prices")
    last = p.agg(F.max("date")).scalar()
    src = p.filter(F.col("date") >= F.date_sub(last, 10)).select(
        (F.col("id") + 100000).alias("id"), F.date_add("date", 1).alias("date"), "market", "state", "district",
        "variety", "min_price", "max_price", "modal_price")
    return IO.append_prices(p, src)


def _save_predictions_sql():
    return forecast_sql() + f"""
SELECT a.as_of AS prediction_date, fc.date AS forecast_date, market,
       predicted_price * 0.95 AS predicted_min_price, predicted_price * 1.05 AS predicted_max_price,
       predicted_price AS predicted_modal_price, {sround('(0.85 - 0.05 * step) * 100', 2)} AS confidence_interval,
       CAST(NULL AS BIGINT) AS model_used_id, CAST(NULL AS DOUBLE) AS actual_price
FROM fc, a"""


def q_save_predictions(spark, sf):
    p = T(spark, sf, "prices")
    a = p.agg(F.max("date")).scalar()
    path = IO.new_output_path(spark, "predictions")
    f = fc.forecast_7d(p, a)
    IO.save_predictions(f, a, path)
    back = spark.read.schema(IO.to_prediction_rows(f, a).schema).parquet(path)
    return back.select("prediction_date", "forecast_date", "market", "predicted_min_price", "predicted_max_price",
                       "predicted_modal_price", "confidence_interval", "model_used_id", "actual_price")


query("save_predictions", _save_predictions_sql())(q_save_predictions)


@query("export_prices_csv", """
SELECT date, market, state, district, variety, min_price, max_price, modal_price, arrival_quantity FROM prices
WHERE contains(lower(state), 'nation_2') AND date BETWEEN DATE '2000-01-01' AND DATE '2000-06-30'""")
def q_export_prices_csv(spark, sf):
    path = IO.export_prices_csv(T(spark, sf, "prices"), IO.new_output_path(spark, "export_prices"), state="NATION_2",
                                start="2000-01-01", end="2000-06-30")
    return spark.read.option("header", True).schema(
        "date date, market string, state string, district string, variety string, min_price double, "
        "max_price double, modal_price double, arrival_quantity double").csv(path)


@query("export_predictions_csv", """
SELECT p.id, p.prediction_date, p.forecast_date, p.market, p.predicted_min_price, p.predicted_modal_price,
       p.predicted_max_price, p.confidence_interval,
       coalesce(CAST(nullif(p.actual_price, 0) AS VARCHAR), '') AS actual_price, coalesce(m.name, '') AS model_used
FROM predictions p LEFT JOIN models m ON p.model_used_id = m.id
WHERE contains(lower(p.market), 'auto') AND p.confidence_interval >= 80""")
def q_export_predictions_csv(spark, sf):
    path = IO.export_predictions_csv(T(spark, sf, "predictions"), T(spark, sf, "models"),
                                     IO.new_output_path(spark, "export_predictions"), market="AUTO", confidence="high")
    back = spark.read.option("header", True).schema(
        "id bigint, prediction_date date, forecast_date date, market string, predicted_min_price double, "
        "predicted_modal_price double, predicted_max_price double, confidence_interval double, actual_price string, "
        "model_used string, created_at timestamp_ntz").csv(path)
    # CSV writes doubles as text; compare the actual price as a number
    # CSV reads '' back as null; compare the actual price as a number
    return back.drop("created_at").withColumns({
        "actual_price": F.coalesce(F.col("actual_price").try_cast("double").cast("string"), F.lit("")),
        "model_used": F.coalesce("model_used", F.lit(""))})


@query("export_predictions_report", f"""
SELECT p.id AS "ID", p.market AS "Market", p.predicted_modal_price AS "Modal Price (₹)", coalesce(m.name, 'N/A') AS "Model Used",
       CASE WHEN p.actual_price IS NOT NULL AND p.actual_price <> 0 AND p.predicted_modal_price <> 0
            THEN printf('%.1f%%', {sround('100 - abs(p.predicted_modal_price - p.actual_price) / p.actual_price * 100', 1)})
            ELSE '' END AS "Accuracy"
FROM predictions p LEFT JOIN models m ON p.model_used_id = m.id WHERE p.forecast_date >= DATE '2001-01-01'""")
def q_export_predictions_report(spark, sf):
    path = IO.export_predictions_report(T(spark, sf, "predictions"), T(spark, sf, "models"),
                                        IO.new_output_path(spark, "report"), start="2001-01-01")
    back = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return back.select(F.col("ID").cast("bigint").alias("ID"), "Market",
                       F.col("`Modal Price (₹)`").cast("double").alias("Modal Price (₹)"), "Model Used",
                       F.coalesce("Accuracy", F.lit("")).alias("Accuracy"))


@query("export_predictions_status", f"""
SELECT id, market, CASE WHEN actual_price IS NOT NULL AND actual_price <> 0 THEN 'Verified' ELSE 'Pending' END AS status,
       CASE WHEN actual_price IS NOT NULL AND actual_price <> 0 AND predicted_modal_price <> 0
            THEN printf('%.1f%%', {sround('100 - abs(predicted_modal_price - actual_price) / actual_price * 100', 1)})
            ELSE '' END AS accuracy
FROM predictions""")
def q_export_predictions_status(spark, sf):
    path = IO.export_predictions_status(T(spark, sf, "predictions"), IO.new_output_path(spark, "status"))
    back = spark.read.option("header", True).csv(path)
    return back.select(F.col("id").cast("bigint").alias("id"), "market", "status",
                       F.coalesce("accuracy", F.lit("")).alias("accuracy"))


@query("prices_json", f"""
SELECT id, date, to_json(struct_pack(date := strftime(date, '%Y-%m-%d'), market := market,
       modal_price := coalesce(modal_price, 0.0), min_price := coalesce(min_price, 0.0),
       max_price := coalesce(max_price, 0.0)))::VARCHAR AS json
FROM prices WHERE date >= CAST({AS_OF_PRICES} - INTERVAL 60 DAY AS DATE) AND lower(market) = 'supplier#000000011'""")
def q_prices_json(spark, sf):
    return IO.prices_json(T(spark, sf, "prices"), None, 60, "SUPPLIER#000000011")


@query("prediction_json", forecast_sql() + """
SELECT market, step, '{"date":"' || strftime(date, '%Y-%m-%d') || '","predicted_price":' || CAST(predicted_price AS VARCHAR)
       || ',"lower_bound":' || CAST(predicted_price * 0.95::DOUBLE AS VARCHAR) || ',"upper_bound":' || CAST(predicted_price * 1.05::DOUBLE AS VARCHAR) || '}' AS json FROM fc""")
def q_prediction_json(spark, sf):
    return IO.prediction_json(fc.forecast_7d(T(spark, sf, "prices")))


def _summary_parts(spark, sf):
    return T(spark, sf, "prices"), T(spark, sf, "factors"), T(spark, sf, "predictions")


@query("home_summary", """
SELECT * FROM (SELECT 'recent_price' AS section, id AS item_id, market AS label, modal_price AS value
               FROM prices ORDER BY date DESC, id DESC LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'factor', id, name, impact_score FROM factors WHERE is_active ORDER BY id LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'prediction', id, market, predicted_modal_price FROM predictions
                         ORDER BY forecast_date DESC, id DESC LIMIT 7)
UNION ALL SELECT 'total_prices', NULL, NULL, CAST(count(*) AS DOUBLE) FROM prices
UNION ALL SELECT 'total_factors', NULL, NULL, CAST(count(*) AS DOUBLE) FROM factors WHERE is_active
UNION ALL SELECT 'total_predictions', NULL, NULL, CAST(count(*) AS DOUBLE) FROM predictions""")
def q_home_summary(spark, sf):
    from ..operators.summary import home_summary
    return home_summary(*_summary_parts(spark, sf))


@query("dashboard_summary", forecast_sql() + """,
t AS (SELECT market, modal_price, row_number() OVER (PARTITION BY market ORDER BY date DESC, id DESC) AS rn FROM h),
g AS (SELECT market, max(CASE WHEN rn = 1 THEN modal_price END) AS c, max(CASE WHEN rn = 2 THEN modal_price END) AS p
      FROM t WHERE rn <= 2 GROUP BY market)
SELECT 'trend' AS section, market AS label,
       CASE WHEN coalesce((c - p) / p * 100, 0) > 5 THEN 'Increasing Rapidly' WHEN coalesce((c - p) / p * 100, 0) > 2 THEN 'Increasing'
            WHEN coalesce((c - p) / p * 100, 0) < -5 THEN 'Decreasing Rapidly' WHEN coalesce((c - p) / p * 100, 0) < -2 THEN 'Decreasing'
            ELSE 'Stable' END AS text, c AS value
FROM g
UNION ALL SELECT 'prediction', market, strftime(date, '%Y-%m-%d'), predicted_price FROM fc
UNION ALL SELECT * FROM (SELECT 'factor', name, factor_type, impact_score FROM factors WHERE is_active ORDER BY id LIMIT 5)""")
def q_dashboard_summary(spark, sf):
    from ..operators.summary import dashboard_summary
    p, f, _ = _summary_parts(spark, sf)
    return dashboard_summary(p, f)


@query("scan_table", f"SELECT {PRICE_COLS} FROM prices")
def q_scan_table(spark, sf):
    # the generic scan (explicit schema, parquet) over the stored price table
    return IO.scan(spark, materialize(spark, sf, ["prices"])["prices"], PRICES, "parquet")


@query("save_model")
def q_save_model(spark, sf):
    # fit, write the pipeline (scaler + model in one artefact) and list what was written
    from ..operators import ml as M
    from .q_models import _split
    tr, _ = _split(spark, sf)
    path = M.save_model(M.train_linear(tr, M.SIMPLE_FEATURES, held=True), IO.new_output_path(spark, "model"))
    return spark.read.json(f"{path}/metadata").select("class", "uid")


@query("load_model")
def q_load_model(spark, sf):
    from ..operators import ml as M
    from .q_models import _split
    tr, te = _split(spark, sf)
    path = M.save_model(M.train_linear(tr, M.SIMPLE_FEATURES, held=True), IO.new_output_path(spark, "model"))
    return M.load_model(path).transform(te).select("id", "market", "prediction")


@query("stream_ingest_prices", f"""
SELECT {PRICE_COLS.replace('id, ', '')}
FROM (SELECT * REPLACE (arrival_quantity + CASE WHEN id % 10 = 0 THEN 1 ELSE 0 END AS arrival_quantity) FROM prices)""")
def q_stream_ingest_prices(spark, sf):
    # the whole price table as uploads, then a second upload with changed rows and rejected ones; both ingested by
    # the file-stream job (validate + upsert per micro-batch) and read back from the newest table version
    from ..streaming.ingest import read_table, start_price_ingest
    base = IO.new_output_path(spark, "stream")
    p = T(spark, sf, "prices")
    IO.export_prices_csv(p, f"{base}/uploads/1", compression="gzip")
    paths = (f"{base}/uploads/*", f"{base}/table", f"{base}/rejects", f"{base}/_checkpoint")
    start_price_ingest(spark, *paths).awaitTermination()
    changed = p.filter(F.col("id") % 10 < 2).withColumns({
        "arrival_quantity": F.col("arrival_quantity") + 1,
        "modal_price": F.when(F.col("id") % 10 == 1, F.lit(-1.0)).otherwise(F.col("modal_price"))})
    IO.export_prices_csv(changed, f"{base}/uploads/2", compression="gzip")
    start_price_ingest(spark, *paths).awaitTermination()
    out = read_table(spark, f"{base}/table")
    if out is None:      # nothing ingested: an empty table with the price columns
        out = spark.createDataFrame([], PRICES)
    return out.drop("id")
