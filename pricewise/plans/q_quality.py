"""Registered queries: data quality and set-based changes (survey 2.2).

The upload batches are derived by Spark from the tables, so they grow with them:
* a *verified-actuals upload* from predictions (date = forecast day, modal = actual price,
  min/max = the predicted band): unverified rows miss a price, actuals outside the band fail
  the modal rule — a natural mix of accepted and rejected rows;
* a *re-priced batch* from prices: each market's last 60 days moved 30 days forward with the
  modal set to the max price, so half the keys update stored rows and half are new.
"""

from pyspark.sql import functions as F

from ..operators import quality as Q
from ..sources.canonical import table
from .registry import query

PRICE_COLS = ["id", "date", "market", "state", "district", "variety", "min_price", "max_price", "modal_price",
              "arrival_quantity"]


def T(spark, sf, name):
    return table(spark, sf, name)


def actuals_upload(spark, sf):
    p = T(spark, sf, "predictions")
    return p.select(F.col("id").alias("file_row"), F.col("forecast_date").cast("string").alias("date"),
                    F.col("market"), F.lit("STATE").alias("state"), F.lit("DISTRICT").alias("district"),
                    F.lit("RED").alias("variety"), F.col("predicted_min_price").cast("string").alias("min_price"),
                    F.col("predicted_max_price").cast("string").alias("max_price"),
                    F.col("actual_price").cast("string").alias("modal_price"),
                    F.col("confidence_interval").cast("string").alias("arrival_quantity"))


ACTUALS_SQL = """
u AS (SELECT id AS file_row, forecast_date AS date, market, predicted_min_price AS min_price,
             predicted_max_price AS max_price, actual_price AS modal_price, confidence_interval AS arrival_quantity
      FROM predictions),
v AS (SELECT *, CASE WHEN market IS NULL OR trim(market) = '' THEN 'Missing required fields'
                     WHEN modal_price IS NULL THEN 'Invalid price'
                     WHEN min_price > max_price THEN 'Min price cannot be greater than max price'
                     WHEN modal_price < min_price OR modal_price > max_price THEN 'Modal price must be between min and max price'
                     WHEN min_price <= 0 OR max_price <= 0 OR modal_price <= 0 THEN 'All prices must be greater than 0'
                END AS reject_reason FROM u)"""


@query("validate_prices", f"""
WITH {ACTUALS_SQL}
SELECT file_row, date, market, min_price, max_price, modal_price, arrival_quantity, reject_reason FROM v""")
def q_validate_prices(spark, sf):
    v = Q.validate_prices(actuals_upload(spark, sf))
    return v.select("file_row", "date", "market", "min_price", "max_price", "modal_price", "arrival_quantity",
                    "reject_reason")


@query("reject_report", f"""
WITH {ACTUALS_SQL},
f AS (SELECT 'Row ' || CAST(file_row + 2 AS VARCHAR) || ': ' || reject_reason AS line, file_row
      FROM v WHERE reject_reason IS NOT NULL ORDER BY file_row LIMIT 5),
c AS (SELECT count(*) FILTER (WHERE reject_reason IS NULL) AS success_count,
             count(*) FILTER (WHERE reject_reason IS NOT NULL) AS error_count FROM v)
SELECT success_count, error_count,
       coalesce((SELECT string_agg(line, '<br>' ORDER BY file_row) FROM f), '')
       || CASE WHEN error_count > 5 THEN '<br>... and ' || CAST(error_count - 5 AS VARCHAR) || ' more errors' ELSE '' END
         AS errors,
       CASE WHEN success_count > 0 THEN 'Successfully imported/updated ' || CAST(success_count AS VARCHAR) || ' price records!' END
         AS success_message,
       CASE WHEN error_count > 0 THEN CAST(error_count AS VARCHAR) || ' records had errors' END AS warning_message
FROM c""")
def q_reject_report(spark, sf):
    return Q.reject_report(Q.validate_prices(actuals_upload(spark, sf)))


def repriced_batch(spark, sf):
    p = T(spark, sf, "prices")
    last = p.agg(F.max("date")).scalar()
    recent = p.filter(F.col("date") > F.date_sub(last, 60))
    return recent.select((F.col("id") + 30).alias("id"), F.date_add("date", 30).alias("date"), "market", "state",
                         "district", "variety", "min_price", "max_price", F.col("max_price").alias("modal_price"),
                         "arrival_quantity", F.col("id").alias("file_row"))


REPRICED_SQL = """
b AS (SELECT id + 30 AS id, CAST(date + INTERVAL 30 DAY AS DATE) AS date, market, state, district, variety, min_price,
             max_price, max_price AS modal_price, arrival_quantity
      FROM prices WHERE date > CAST((SELECT max(date) FROM prices) - INTERVAL 60 DAY AS DATE))"""


@query("upsert_prices", f"""
WITH {REPRICED_SQL}
SELECT p.* FROM prices p WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.market = p.market AND b.date = p.date)
UNION ALL
SELECT coalesce(p.id, b.id) AS id, b.date, b.market, b.state, b.district, b.variety, b.min_price, b.max_price,
       b.modal_price, b.arrival_quantity
FROM b LEFT JOIN prices p ON b.market = p.market AND b.date = p.date""")
def q_upsert_prices(spark, sf):
    return Q.upsert_prices(T(spark, sf, "prices"), repriced_batch(spark, sf))


@query("upsert_prices_new_ids", f"""
WITH {REPRICED_SQL},
j AS (SELECT b.* REPLACE (p.id AS id) FROM b LEFT JOIN prices p ON b.market = p.market AND b.date = p.date)
SELECT p.* FROM prices p WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.market = p.market AND b.date = p.date)
UNION ALL SELECT * FROM j WHERE id IS NOT NULL
UNION ALL SELECT * REPLACE ((SELECT max(id) FROM prices) + row_number() OVER (ORDER BY market, date) AS id) FROM j WHERE id IS NULL""")
def q_upsert_prices_new_ids(spark, sf):
    # the batch names no ids: updated rows keep theirs, inserted rows get the next ones
    return Q.upsert_prices(T(spark, sf, "prices"), repriced_batch(spark, sf).drop("id"))


@query("anti_new_prices", f"""
WITH {REPRICED_SQL}
SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM prices p WHERE b.market = p.market AND b.date = p.date)""")
def q_anti_new_prices(spark, sf):
    from ..operators.selection import anti_new
    return anti_new(repriced_batch(spark, sf).drop("file_row"), T(spark, sf, "prices"), ["market", "date"])


def candidates(spark, sf):
    c = table(spark, sf, "users")
    k = F.col("user_id")
    return c.select(k.alias("candidate_id"),
                    F.when(k % 4 == 0, F.col("username")).otherwise(F.concat(F.lit("new_"), "username")).alias("username"),
                    F.when(k % 6 == 0, F.col("email")).otherwise(F.concat(F.lit("new_"), "email")).alias("email"))


@query("check_unique_users", """
WITH c AS (SELECT user_id AS candidate_id,
                  CASE WHEN user_id % 4 = 0 THEN username ELSE 'new_' || username END AS username,
                  CASE WHEN user_id % 6 = 0 THEN email ELSE 'new_' || email END AS email FROM users)
SELECT c.*, CASE WHEN EXISTS (SELECT 1 FROM users u WHERE u.username = c.username) THEN 'username exists'
                 WHEN EXISTS (SELECT 1 FROM users u WHERE u.email = c.email) THEN 'email exists' ELSE 'accepted' END AS status,
       CASE WHEN EXISTS (SELECT 1 FROM users u WHERE u.username = c.username) THEN 'Username "' || c.username || '" already exists'
            WHEN EXISTS (SELECT 1 FROM users u WHERE u.email = c.email) THEN 'Email "' || c.email || '" already exists'
       END AS message
FROM c""")
def q_check_unique_users(spark, sf):
    return Q.check_unique_users(T(spark, sf, "users"), candidates(spark, sf))


@query("validate_factors", """
SELECT id, name, nullif(factor_type, '') AS factor_type, description, impact_score, is_active,
       CASE WHEN name IS NULL OR trim(name) = '' THEN 'Factor name is required'
            WHEN impact_score < 0 OR impact_score > 90 THEN 'Impact score must be between 0 and 90' END AS reject_reason
FROM factors""")
def q_validate_factors(spark, sf):
    return Q.validate_factors(T(spark, sf, "factors"), 0, 90)


@query("validate_messages", """
SELECT *, CASE WHEN name IS NULL OR trim(name) = '' OR email IS NULL OR trim(email) = '' OR message IS NULL
                    OR trim(message) = '' THEN 'Please fill in all required fields.' END AS reject_reason
FROM messages""")
def q_validate_messages(spark, sf):
    return Q.validate_messages(T(spark, sf, "messages"))


@query("delete_by_ids", "SELECT * FROM prices WHERE id NOT IN (SELECT id FROM prices WHERE arrival_quantity > 100)")
def q_delete_by_ids(spark, sf):
    p = T(spark, sf, "prices")
    kept, _ = Q.delete_by_ids(p, p.filter(F.col("arrival_quantity") > 100).select("id"))
    return kept


@query("delete_by_ids_count", "SELECT count(*) AS deleted FROM prices WHERE arrival_quantity > 100")
def q_delete_by_ids_count(spark, sf):
    p = T(spark, sf, "prices")
    _, n = Q.delete_by_ids(p, p.filter(F.col("arrival_quantity") > 100).select("id"))
    return n


@query("delete_by_filter", """
SELECT * FROM predictions WHERE NOT coalesce(contains(lower(market), 'mach') AND actual_price > 100000, false)""")
def q_delete_by_filter(spark, sf):
    from ..functions import predicates as P
    kept, _ = Q.delete_by_filter(T(spark, sf, "predictions"),
                                 P.contains("market", "mach") & (F.col("actual_price") > 100000))
    return kept


@query("delete_by_filter_count", """
SELECT count(*) FILTER (WHERE coalesce(contains(lower(market), 'mach') AND actual_price > 100000, false)) AS deleted
FROM predictions""")
def q_delete_by_filter_count(spark, sf):
    from ..functions import predicates as P
    _, n = Q.delete_by_filter(T(spark, sf, "predictions"),
                              P.contains("market", "mach") & (F.col("actual_price") > 100000))
    return n


@query("update_by_key", """
SELECT p.id, p.date, p.market, p.state, p.district, p.variety, p.min_price, p.max_price,
       coalesce(c.modal_price, p.modal_price) AS modal_price, p.arrival_quantity
FROM prices p LEFT JOIN (SELECT id, max_price AS modal_price FROM prices WHERE arrival_quantity > 90) c ON p.id = c.id""")
def q_update_by_key(spark, sf):
    p = T(spark, sf, "prices")
    ch = p.filter(F.col("arrival_quantity") > 90).select("id", F.col("max_price").alias("modal_price"))
    return Q.update_by_key(p, ch)


@query("toggle_user_status", """
SELECT user_id, username, email, first_name, last_name,
       CASE WHEN user_id % 10 = 0 THEN NOT is_active ELSE is_active END AS is_active,
       is_staff, is_superuser, date_joined, last_login
FROM users""")
def q_toggle_user_status(spark, sf):
    u = T(spark, sf, "users")
    return Q.toggle_flag(u, u.filter(F.col("user_id") % 10 == 0).select("user_id"), "is_active", "user_id")


@query("mark_messages_read", """
SELECT id, name, email, phone, subject, user_type, message, subscribed_to_alerts, created_at,
       CASE WHEN subject = 'de' THEN TRUE ELSE is_read END AS is_read
FROM messages""")
def q_mark_messages_read(spark, sf):
    m = T(spark, sf, "messages")
    return Q.set_flag(m, m.filter(F.col("subject") == "de").select("id"), True, "is_read", "id")


@query("activate_users", """
SELECT user_id, username, (is_active OR user_id % 10 = 0) AS is_active FROM users""")
def q_activate_users(spark, sf):
    u = T(spark, sf, "users")
    return Q.set_flag(u, u.filter(F.col("user_id") % 10 == 0).select("user_id"), True, "is_active", "user_id") \
        .select("user_id", "username", "is_active")


@query("deactivate_users", """
SELECT user_id, username, (is_active AND user_id % 10 <> 0) AS is_active FROM users""")
def q_deactivate_users(spark, sf):
    u = T(spark, sf, "users")
    return Q.set_flag(u, u.filter(F.col("user_id") % 10 == 0).select("user_id"), False, "is_active", "user_id") \
        .select("user_id", "username", "is_active")
