"""Data quality and set-based table changes (survey 2.2).

The app validates and upserts uploads row by row with a SELECT and an INSERT/UPDATE per
row; here every rule is one ``when`` chain and every change is a join:
upsert = (target anti-join source keys) union (deduplicated source).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from ..schemas import PRICE_COLUMNS

# Rejection reasons, in the order the rules are applied.
REASON_MISSING = "Missing required fields"
REASON_BAD_DATE = "Invalid date"
REASON_BAD_PRICE = "Invalid price"
REASON_MIN_MAX = "Min price cannot be greater than max price"
REASON_MODAL = "Modal price must be between min and max price"
REASON_NOT_POSITIVE = "All prices must be greater than 0"
# Form messages.
MSG_FACTOR_NAME = "Factor name is required"
MSG_FACTOR_IMPACT = "Impact score must be between %g and %g"
MSG_CONTACT_REQUIRED = "Please fill in all required fields."
MSG_USERNAME_EXISTS = 'Username "%s" already exists'
MSG_EMAIL_EXISTS = 'Email "%s" already exists'
MSG_IMPORTED = "Successfully imported/updated %d price records!"
MSG_HAD_ERRORS = "%d records had errors"


def _blank(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")


def _num(c: str) -> Column:
    v = F.col(c).cast("string").try_cast("double")
    return F.when(~F.isnan(v), v)


def validate_prices(df: DataFrame) -> DataFrame:
    """Typed price rows plus ``reject_reason`` (null = accepted); the first failing rule wins.

    Accepts text or typed input.  Unparseable, null and NaN prices get their own reason (a
    NaN would otherwise pass every comparison); ``arrival_quantity`` defaults to 0.
    """
    d = F.col("date").cast("string").try_cast("date") if dict(df.dtypes).get("date") != "date" else F.col("date")
    mn, mx, md = _num("min_price"), _num("max_price"), _num("modal_price")
    aq = _num("arrival_quantity") if "arrival_quantity" in df.columns else F.lit(None).cast("double")
    missing = _blank("date") | _blank("market") | _blank("state") | _blank("district") | _blank("variety")
    reason = (F.when(missing, REASON_MISSING)
              .when(d.isNull(), REASON_BAD_DATE)
              .when(mn.isNull() | mx.isNull() | md.isNull(), REASON_BAD_PRICE)
              .when(mn > mx, REASON_MIN_MAX)
              .when((md < mn) | (md > mx), REASON_MODAL)
              .when((mn <= 0) | (mx <= 0) | (md <= 0), REASON_NOT_POSITIVE))
    keep = [c for c in df.columns if c not in PRICE_COLUMNS]
    return df.select(*keep, d.alias("date"), "market", "state", "district", "variety",
                     mn.alias("min_price"), mx.alias("max_price"), md.alias("modal_price"),
                     F.coalesce(aq, F.lit(0.0)).alias("arrival_quantity"), reason.alias("reject_reason"))


def reject_report(validated: DataFrame, show: int = 5, row_col: str = "file_row") -> DataFrame:
    """One row: success/error counts and the first ``show`` errors as 'Row n: reason'
    (n = file row + 2, i.e. the spreadsheet line), then '... and k more errors'."""
    bad = validated.filter(F.col("reject_reason").isNotNull())
    first = (bad.orderBy(row_col).limit(show)
             .agg(F.array_sort(F.collect_list(F.struct(row_col, "reject_reason"))).alias("e")))
    lines = F.transform(F.col("e"), lambda x: F.format_string("Row %d: %s", x[row_col] + 2, x["reject_reason"]))
    counts = validated.agg(F.count_if(F.col("reject_reason").isNull()).alias("success_count"),
                           F.count_if(F.col("reject_reason").isNotNull()).alias("error_count"))
    msg = first.select(F.array_join(lines, "<br>").alias("m")).scalar()
    more = F.when(F.col("error_count") > show,
                  F.format_string("<br>... and %d more errors", F.col("error_count") - show)).otherwise(F.lit(""))
    return counts.select(
        "success_count", "error_count", F.concat(F.coalesce(msg, F.lit("")), more).alias("errors"),
        F.when(F.col("success_count") > 0, F.format_string(MSG_IMPORTED, "success_count")).alias("success_message"),
        F.when(F.col("error_count") > 0, F.format_string(MSG_HAD_ERRORS, "error_count")).alias("warning_message"))


def dedupe_last(df: DataFrame, keys, order_col: str = "file_row") -> DataFrame:
    """One row per key: the latest by ``order_col`` (later file rows override earlier).

    ``max_by`` is combined map-side, so a key repeated across a third of the upload costs
    one buffer per task instead of one task holding all its rows (a window would).
    """
    others = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(order_col)).alias("_r"))
    return g.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in others])


def number_new(new: DataFrame, order, id_col: str = "id", last_id: Column | int = 0) -> DataFrame:
    """``new`` with ids ``last_id + 1``, ``+ 2``, ... in ``order``: no gap and no duplicate, and no task that sees
    all rows (range layout and the sizes of its pieces, see ``long_series.series_positions``)."""
    from .long_series import POS, series_positions
    rows = series_positions(new.drop(id_col).withColumn("_all", F.lit(0)), keys=["_all"], order=list(order))
    base = last_id if isinstance(last_id, Column) else F.lit(last_id)
    return rows.withColumn(id_col, (base + 1 + F.col(POS)).cast("long")).drop("_all", POS)


def _between(source: DataFrame, keys) -> Column:
    """The row's keys lie between the least and the greatest of ``source``, one by one; false for null keys, which match none."""
    b = source.agg(*[f(k).alias(f"{n}_{k}") for k in keys for n, f in (("min", F.min), ("max", F.max))]).first()
    inside = reduce(lambda x, y: x & y, [F.col(k).between(F.lit(b[f"min_{k}"]), F.lit(b[f"max_{k}"])) for k in keys])
    return F.coalesce(inside, F.lit(False))


def upsert_prices(target: DataFrame, source: DataFrame, keys=("market", "date"), order_col: str = "file_row",
                  id_col: str = "id", last_id: Column | int | None = None) -> DataFrame:
    """Update rows whose key exists, insert the rest.  An updated row keeps the stored id; an inserted row keeps an
    id that the source gives and else gets the next one, in the order of the keys, above all ids in use
    (``last_id``, by default the greatest of the table and the source).

    Every join keeps the (usually small) upload on the build side, so Spark can broadcast it
    when its size allows and the stored table is scanned without a shuffle:
    ids of updated keys = target INNER JOIN source keys; kept rows = target ANTI JOIN source
    keys.  With a large upload the same plan runs as shuffle joins, of those stored rows only whose keys lie
    between the least and the greatest of the upload (all others are kept as they are).  Where the table format
    supports it, this is a ``MERGE INTO``.
    """
    ks = list(keys)
    src = dedupe_last(source, ks, order_col) if order_col in source.columns else source
    cols = target.columns
    src_keys = src.select(*ks)
    near = _between(source, ks)
    if id_col in cols:
        hits = target.filter(near).select(*ks, F.col(id_col).alias("_old_id")).join(src_keys, ks, "inner")
        given = F.col(id_col) if id_col in src.columns else F.lit(None).cast("long")
        if last_id is None:
            used = target.select(id_col)
            if id_col in src.columns:
                used = used.unionByName(src.select(id_col))
            last_id = used.agg(F.coalesce(F.max(id_col), F.lit(0))).scalar()
        # The upload, without duplicates and with the ids it has so far, is written once: the parts below read it.
        src = stored(src.join(hits, ks, "left").withColumn(id_col, F.coalesce("_old_id", given)).select(*cols), "upload")
        src_keys = src.select(*ks)
        new = number_new(src.filter(F.col(id_col).isNull()), ks, id_col, last_id)
        src = src.filter(F.col(id_col).isNotNull()).unionByName(new.select(*cols))
    kept = target.filter(near).join(src_keys, ks, "left_anti")
    return target.filter(~near).unionByName(kept).unionByName(src.select(*cols))


def check_unique_users(users: DataFrame, candidates: DataFrame, order_col: str | None = None) -> DataFrame:
    """Candidates tagged 'username exists' / 'email exists' / 'accepted' (joins, no loop).

    Of candidates that share a name or an e-mail the first by ``order_col`` (unique) holds; without one, the
    first as the rows stand, which for rows out of a shuffle is any of them.

    The stored users are matched against the candidates' names and e-mails (candidates on the
    build side), so a short candidate list never shuffles the user table."""
    names = (users.select(F.col("username").alias("_u"))
             .join(candidates.select(F.col("username").alias("_u")).distinct(), "_u", "left_semi").distinct())
    mails = (users.select(F.col("email").alias("_e"))
             .join(candidates.select(F.col("email").alias("_e")).distinct(), "_e", "left_semi").distinct())
    at = F.col(order_col) if order_col else F.monotonically_increasing_id()
    c = (candidates.withColumn("_at", at)
         .join(names, candidates.username == names._u, "left")
         .join(mails, candidates.email == mails._e, "left"))
    # users are added one at a time: a name or an e-mail belongs to the first candidate that the stored users let pass
    first = c.filter(F.col("_u").isNull() & F.col("_e").isNull())
    by_name = first.groupBy(F.col("username").alias("_n")).agg(F.min("_at").alias("_n_at"))
    by_mail = first.groupBy(F.col("email").alias("_m")).agg(F.min("_at").alias("_m_at"))
    c = (c.join(by_name, F.col("username") == F.col("_n"), "left").join(by_mail, F.col("email") == F.col("_m"), "left")
         .withColumn("_u", F.coalesce("_u", F.when(F.col("_n_at") < F.col("_at"), F.col("username"))))
         .withColumn("_e", F.coalesce("_e", F.when(F.col("_m_at") < F.col("_at"), F.col("email")))))
    status = (F.when(F.col("_u").isNotNull(), "username exists").when(F.col("_e").isNotNull(), "email exists")
              .otherwise("accepted"))
    message = (F.when(F.col("_u").isNotNull(), F.format_string(MSG_USERNAME_EXISTS, F.col("username")))
               .when(F.col("_e").isNotNull(), F.format_string(MSG_EMAIL_EXISTS, F.col("email"))))
    return c.withColumns({"status": status, "message": message}).select(*candidates.columns, "status", "message")


def validate_factors(df: DataFrame, lo: float = 0, hi: float = 100) -> DataFrame:
    name_missing = _blank("name")
    impact = F.col("impact_score").cast("string").try_cast("double")
    reason = (F.when(name_missing, MSG_FACTOR_NAME)
              .when(impact.isNull() | (impact < lo) | (impact > hi), MSG_FACTOR_IMPACT % (lo, hi)))
    return df.withColumns({"factor_type": F.nullif(F.col("factor_type"), F.lit("")), "reject_reason": reason})


def validate_messages(df: DataFrame) -> DataFrame:
    reason = F.when(_blank("name") | _blank("email") | _blank("message"), MSG_CONTACT_REQUIRED)
    return df.withColumn("reject_reason", reason)


def delete_by_ids(df: DataFrame, ids: DataFrame, col: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows kept, one-row count of rows deleted)."""
    key = ids.select(F.col(ids.columns[0]).alias(col)).distinct()
    kept = df.join(key, col, "left_anti")
    deleted = df.join(key, col, "left_semi").agg(F.count(F.lit(1)).alias("deleted"))
    return kept, deleted


def delete_by_filter(df: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """Rows kept are those where the predicate is not TRUE — a null predicate keeps the row
    (``filter(~pred)`` would drop it)."""
    hit = F.coalesce(predicate, F.lit(False))
    return df.filter(~hit), df.agg(F.count_if(hit).alias("deleted"))


def update_by_key(df: DataFrame, changes: DataFrame, key: str = "id", order_col: str | None = None) -> DataFrame:
    """Overwrite the columns present in ``changes`` for the keys it lists (null = unchanged).

    A key listed twice changes its row once: the last by ``order_col`` holds, or the greatest where none is named."""
    cols = [c for c in changes.columns if c not in (key, order_col)]
    row = F.struct(*cols)
    pick = F.max_by(row, F.col(order_col)) if order_col else F.max(row)
    ch = changes.groupBy(key).agg(pick.alias("_c")).select(key, *[F.col(f"_c.{c}").alias(f"_new_{c}") for c in cols])
    j = df.join(ch, key, "left")
    return j.select(*[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in cols else F.col(c)
                      for c in df.columns])


def set_flag(df: DataFrame, ids: DataFrame, value: bool, flag: str = "is_active", key: str = "id") -> DataFrame:
    """Set a boolean for the listed keys (mark read, activate, deactivate)."""
    hit = ids.select(F.col(ids.columns[0]).alias(key)).distinct().withColumn("_hit", F.lit(True))
    j = df.join(hit, key, "left")
    return j.select(*[F.when(F.col("_hit"), F.lit(value)).otherwise(F.col(c)).alias(c) if c == flag else F.col(c)
                      for c in df.columns])


def toggle_flag(df: DataFrame, ids: DataFrame, flag: str = "is_active", key: str = "id") -> DataFrame:
    """Flip a boolean for the listed keys."""
    hit = ids.select(F.col(ids.columns[0]).alias(key)).distinct().withColumn("_hit", F.lit(True))
    j = df.join(hit, key, "left")
    return j.select(*[F.when(F.col("_hit"), ~F.col(c)).otherwise(F.col(c)).alias(c) if c == flag else F.col(c)
                      for c in df.columns])


def apply_actual_prices(predictions: DataFrame, prices: DataFrame, keys=("market",)) -> DataFrame:
    """Fill ``actual_price`` from the observed price of the same market and forecast day."""
    from .selection import join_actuals
    j = join_actuals(predictions, prices, "forecast_date", keys)
    return j.withColumn("actual_price", F.coalesce("observed_price", "actual_price")).drop("observed_price")
