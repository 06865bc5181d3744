"""Quality rules with thresholds that follow the corpus (DataFrame functions only).

Fixed part (base): a text fails with under 50 words, or when over half of its words lie in three-word
windows that occur twice or more in it.  Adaptive part: four ratios per document go into quantile
sketches per (language, source) - counts in buckets of bounded relative width, which merge by
addition, so partial sums run before the shuffle and a hot group costs no more than its buckets.
A threshold is the sketch's median plus ``REACH`` times the distance to its upper quartile, but at
least ``SLACK`` above the median and at most ``CEILING``, so that a group in which up to a quarter of the
documents is junk still loses it; documents join to their group's thresholds and fall out above one.

Defined cases: null text = no words; null language or source is a group of its own; ties share a
bucket; repeated rows count each; an empty table gives an empty result.  Other columns are not read
by ``verdicts``; ``filter_documents`` hands all columns on, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewise.llm.common import keep, text_or_empty

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Sub-buckets per power of two: a bucket is at most 1/16 wide, relative to its values.
SUB = 16
UPPER, REACH = 0.75, 4
#: Least distance of a threshold from the median, in thousandths (word length: of a character): one repeated line in a text of three is not an outlier.
SLACK = {"symbols": 100, "dup_lines": 400, "repeats": 200, "word_len": 3000}
#: Largest threshold: a symbol a word, seven lines in ten, the base rule's share of repeats, twenty characters a word.
CEILING = {"symbols": 1000, "dup_lines": 700, "repeats": 10 * MAX_REPEAT_PERCENT, "word_len": 20_000}


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds to a frame of packed rows (``d``) the struct ``m``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    t = text_or_empty(text)
    x = docs.withColumn("_t", t).withColumn("_w", F.array_remove(F.split(F.translate("_t", "\t\n\x0b\x0c\r", "     "), " "), ""))
    # A window is known by the hash of its three words, and its place; equal hashes come together in order.
    x = x.withColumn("_n", F.size("_w"))
    x = x.withColumn("_s", F.expr("sort_array(transform(sequence(0, greatest(_n - 3, 0)), i -> named_struct('h', xxhash64(get(_w, i), get(_w, i + 1), get(_w, i + 2)), 'i', i)))"))
    # Places whose window equals the one before it in this order, then those equal to the one before or after.
    x = x.withColumn("_e", F.expr("zip_with(_s, concat(array(cast(null as struct<h:bigint,i:int>)), slice(_s, 1, size(_s) - 1)), (x, y) -> named_struct('i', x.i, 'again', coalesce(x.h = y.h, false)))"))
    x = x.withColumn("_a", F.expr("sort_array(filter(zip_with(_e, slice(_e, 2, size(_e)), (x, y) -> if(x.again or coalesce(y.again, false), x.i, null)), i -> i is not null))"))
    covered = F.expr("aggregate(zip_with(_a, slice(_a, 2, size(_a)), (x, y) -> least(3, coalesce(y - x, 3))), 0L, (n, c) -> n + c)")
    lines = F.filter(F.split("_t", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    x = x.withColumn("_l", lines)
    m = F.struct(
        F.col("_n").cast("long").alias("n_words"),
        F.char_length(F.translate("_t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.char_length("_t") - F.char_length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"), F.size("_l").cast("long").alias("n_lines"))
    # Exploding one struct keeps later filters on the measures from being pushed down into (and repeating) their expressions.
    return x.withColumn("m", F.explode(F.array(m))).drop("_t", "_w", "_n", "_s", "_e", "_a", "_l")


def ratios() -> dict[str, Column]:
    """In thousandths, of ``m``."""
    per = lambda a, b: F.floor(F.col(a) * 1000 / F.greatest(F.col(b), F.lit(1)))
    return {"symbols": per("m.n_symbols", "m.n_words"), "dup_lines": per("m.n_dup_lines", "m.n_lines"), "repeats": per("m.n_repeat_words", "m.n_words"), "word_len": per("m.word_chars", "m.n_words")}


def bucket(v: Column) -> Column:
    """Smallest integer of the bucket of a non-negative integer: exact below 2 * SUB, then SUB buckets for each power of two."""
    v = v.cast("long")
    bits = F.length(F.bin(v))
    wide = F.pow(F.lit(2.0), F.greatest(F.lit(0), bits - 5)).cast("long")
    return v - F.pmod(v, wide)


def base_failed() -> Column:
    return (F.col("m.n_words") < MIN_WORDS) | (F.col("m.n_repeat_words") * 100 > F.col("m.n_words") * MAX_REPEAT_PERCENT)


def thresholds(measured: DataFrame) -> DataFrame:
    """lang, source, and a map from ratio to its threshold; ``measured`` has lang, source, m.  All documents count."""
    r = ratios()
    long = measured.select("lang", "source", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), bucket(v).alias("b")) for k, v in r.items()])).alias("x"))
    sketch = long.groupBy("lang", "source", F.col("x.k").alias("k"), F.col("x.b").alias("b")).agg(F.count("*").alias("n"))
    group = Window.partitionBy("lang", "source", "k")
    up = sketch.withColumn("upto", F.sum("n").over(group.orderBy("b"))).withColumn("of", F.sum("n").over(group))
    q = up.groupBy("lang", "source", "k").agg(
        F.min(F.when(F.col("upto") >= F.col("of") * F.lit(0.5), F.col("b"))).alias("mid"),
        F.min(F.when(F.col("upto") >= F.col("of") * F.lit(UPPER), F.col("b"))).alias("high"))
    of = lambda table: F.coalesce(*[F.when(F.col("k") == k, F.lit(v)) for k, v in table.items()])
    limit = F.least(F.col("mid") + F.greatest(of(SLACK), REACH * (F.col("high") - F.col("mid"))), of(CEILING))
    return q.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("k", limit.cast("long").alias("v")))).alias("limits"))


def judged(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds base_failed and kept."""
    a = measured.alias("a")
    x = a.join(limits.alias("b"), F.col("a.lang").eqNullSafe(F.col("b.lang")) & F.col("a.source").eqNullSafe(F.col("b.source")), "left").select("a.*", "limits")
    above = [F.coalesce(v > F.col("limits")[k], F.lit(False)) for k, v in ratios().items()]
    any_above = above[0] | above[1] | above[2] | above[3]
    return x.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~any_above).drop("limits")


def verdicts(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the base measures, base_failed, kept.  The measures (five numbers a row) are
    written once, as both the sketches and the joined filter need them."""
    m = measure(docs.select("doc_id", "lang", "source", "text")).select("doc_id", "lang", "source", "m")
    m = keep(m, "quality")
    return judged(m, keep(thresholds(m), "limits")).select("doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words", "base_failed", "kept")


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns.  Documents are measured once and written with their
    measures, of which the sketches then read only columns of numbers; the thresholds, a few rows a group, are a table
    whose size Spark knows, so that it is broadcast while it is small and no text is dealt by group."""
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("d"))
    packed = packed.select("d", F.col("d.lang").alias("lang"), F.col("d.source").alias("source"), F.col("d.text").alias("text"))
    measured = keep(measure(packed).select("d", "lang", "source", "m"), "measured")
    return judged(measured, keep(thresholds(measured), "limits")).where("kept").select("d.*")
