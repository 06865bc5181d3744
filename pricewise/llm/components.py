"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewise.llm.common import KEPT, keep, release
from pricewise.session import shuffles_dropped


def components(links: DataFrame) -> DataFrame:
    """``links``: a, b (long).  Returns node, label: the smallest node that links reach, for every node with a link.

    Each round hangs neighbours on smaller nodes; rounds grow with the logarithm of the longest path.  Minima are
    pre-aggregated before the shuffle, and rounds are cut by tables in the shared folder; a round's table goes when the
    next one is written.
    """
    spark = links.sparkSession
    e = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, seen = keep(e, "links"), None
    while True:
        last = KEPT[-1]
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("x"), "m"), F.struct(F.col("v").alias("x"), "m"))).alias("s"))
        e = keep(small.select(F.col("s.x").alias("u"), F.col("s.m").alias("v")).where("u <> v").distinct(), "links")
        release(spark, [last])
        with shuffles_dropped(spark):
            now = tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))), F.lit(0))).first())
        if now == seen or now[0] == 0:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
