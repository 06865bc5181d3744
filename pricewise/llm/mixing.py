"""Mixing sources to target weights by Poisson replication (DataFrame functions only).

A source's mean repetition rate is target share x total size / size of the source.  Each document's
count is the inverse of the Poisson distribution with that mean at a uniform number made from a hash
of (seed, doc_id); the document is exploded by its count, and the copies are shuffled globally by a
hash of (seed, doc_id, copy).  Means over ``PIECE`` are sums of independent smaller ones, so the
distribution tables stay short and exp() cannot underflow.

Sizes are code points of text, summed per source before the shuffle.  Rates have one row per source
and are written as a table of their own, so that Spark knows their size when it plans the join with the
documents: under its limit they are broadcast and texts move only once, in the final shuffle; beyond it
hot sources are split (adaptive skew join).

Defined cases: null source is a source of its own; null text has size 0; a source of size 0 gets
rate 0 unless all sources are empty (then 1); null doc_id hashes as ``null``; repeated rows of one
doc_id get the same count; an empty table gives an empty table; other columns are carried along
inside one struct, whatever their names; one named like an output is replaced by it (or stays, where no
outputs are asked for).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewise.llm.common import keep

#: Largest mean that is inverted at once; the table of its distribution function ends below 2**-52.
PIECE = 16.0
TAIL = 80


def uniform(*parts: Column) -> Column:
    """In (0, 1), from the first 52 bits of an MD5 of the parts."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def rates(docs: DataFrame, power: float, total_rate: float, source: str = "source", text: str = "text") -> DataFrame:
    """source, rate: target shares are proportional to size ** power; the sum of expected sizes is total_rate x the corpus."""
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.sum(F.coalesce(F.length(text), F.lit(0))).cast("double").alias("size"))
    everything = sizes.agg(F.sum("size").alias("all_size"), F.sum(F.when(F.col("size") > 0, F.pow("size", F.lit(power)))).alias("all_weight"))
    # The totals are one row.
    return sizes.join(F.broadcast(everything)).select("source", F.when(F.col("all_size") == 0, 1.0).when(F.col("size") == 0, 0.0).otherwise(
        F.lit(total_rate) * F.pow("size", F.lit(power)) / F.col("all_weight") * F.col("all_size") / F.col("size")).alias("rate"))


def with_tables(rated: DataFrame) -> DataFrame:
    """Adds pieces and cdf: the Poisson distribution function of rate / pieces at 0 .. TAIL - 1."""
    x = rated.withColumn("pieces", F.greatest(F.lit(1), F.ceil(F.col("rate") / PIECE)).cast("int"))
    mean = F.col("rate") / F.col("pieces")
    term = lambda k: F.exp(-mean) * F.pow(mean, F.lit(float(k))) / F.lit(float(math.factorial(k)))
    pmf = F.array(*[term(k) for k in range(TAIL)])
    return x.withColumn("pmf", pmf).select(
        "source", "rate", "pieces",
        F.expr("aggregate(pmf, cast(array() as array<double>), (a, p) -> array_append(a, coalesce(try_element_at(a, -1), 0D) + p))").alias("cdf"))


def replicate(docs: DataFrame, seed: int = 17, power: float = 0.7, total_rate: float = 1.0, doc_id: str = "doc_id", source: str = "source", text: str = "text", outputs: bool = True) -> DataFrame:
    """Columns of docs, then (with ``outputs``) ``mix_copy`` (from 0) and ``mix_key``; partitions hold random documents, sorted by the key."""
    table = keep(with_tables(rates(docs, power, total_rate, source, text)), "rates")
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("d"))
    joined = packed.join(table, F.col(f"d.`{source}`").eqNullSafe(F.col("source")))
    draws = F.transform(F.sequence(F.lit(1), F.col("pieces")), lambda j: uniform(F.lit(seed), F.col(f"d.`{doc_id}`"), j))
    # A number beyond the table's end (under 2**-52) counts as TAIL.
    count = F.aggregate("draws", F.lit(0), lambda a, u: a + F.size(F.filter("cdf", lambda c: c < u)))
    copies = joined.select("d", "cdf", draws.alias("draws")).select("d", count.alias("n")).where("n > 0").select("d", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("mix_copy"))
    keyed = copies.withColumn("mix_key", F.md5(F.concat_ws(":", F.lit(f"{seed} order"), F.coalesce(F.col(f"d.`{doc_id}`").cast("string"), F.lit("null")), F.col("mix_copy").cast("string"))))
    spread = keyed.repartition(F.col("mix_key")).sortWithinPartitions("mix_key")
    more = ["mix_copy", "mix_key"] if outputs else []
    return spread.select(*[F.col(f"d.`{c}`") for c in docs.columns if c not in more], *more)
