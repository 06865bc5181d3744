"""Token counts: an exact histogram of encoded lengths.

Texts are encoded in Arrow batches and only their lengths leave Python.  Documents are counted by
length (partial sums before the shuffle); suffix sums over the histogram then answer, for every
context limit at which an answer changes, the documents and tokens within it, the total truncated to
it and the quantile it stands for.  The suffix sums are two-level - within blocks of lengths, then
over the block totals - so no task holds the whole histogram.

Defined cases: null text = empty text = length 0; repeated rows count each; an empty table gives an
empty histogram; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricewise.llm.common import keep, python_ready, text_or_empty

#: Lengths per block of the suffix sums.
BLOCK = 4096


def _encoder(ranks_path: str, pattern: str, cache: dict = {}):  # noqa: B006 - one per worker process
    if ranks_path not in cache:
        import base64

        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        cache[ranks_path] = tiktoken.Encoding("lengths", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return cache[ranks_path]


def encoded_lengths(df: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """One column ``n_tokens``: the encoded length of each row's text."""
    python_ready(df.sparkSession)

    def run(batches):
        import pyarrow as pa

        enc = _encoder(ranks_path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(enc.encode_ordinary(t)) for t in b.column(0).to_pylist()], pa.int64())], names=["n_tokens"])

    return df.select(text_or_empty(text).alias("text")).mapInArrow(run, "n_tokens bigint")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """Per distinct length: n_docs, and for that length as the context limit: docs_within, tokens_within,
    docs_longer, truncated_total (sum of min(length, limit)), total_tokens, quantile (share of documents within)."""
    # One row per length, written once: both levels of the suffix sums read it, and no text is encoded again.
    by_length = keep(lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "lengths")
    by_length = by_length.withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    blocks = by_length.groupBy("block").agg(F.sum("n_docs").alias("b_docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("b_tokens"))
    # One row per block: as many as the longest text has blocks of lengths, whatever the number of documents.
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select("block", F.coalesce(F.sum("b_docs").over(later), F.lit(0)).alias("s_docs"), F.coalesce(F.sum("b_tokens").over(later), F.lit(0)).alias("s_tokens"),
                           F.sum("b_docs").over(every).alias("all_docs"), F.sum("b_tokens").over(every).alias("all_tokens"))
    inner = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    x = by_length.join(blocks, "block").select(
        "n_tokens", "n_docs", "all_docs", "all_tokens",
        (F.col("s_docs") + F.coalesce(F.sum("n_docs").over(inner), F.lit(0))).alias("docs_longer"),
        (F.col("s_tokens") + F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")).over(inner), F.lit(0))).alias("tokens_longer"))
    return x.select(
        "n_tokens", "n_docs", (F.col("all_docs") - F.col("docs_longer")).alias("docs_within"), (F.col("all_tokens") - F.col("tokens_longer")).alias("tokens_within"),
        "docs_longer", (F.col("all_tokens") - F.col("tokens_longer") + F.col("docs_longer") * F.col("n_tokens")).alias("truncated_total"),
        F.col("all_tokens").alias("total_tokens"), ((F.col("all_docs") - F.col("docs_longer")) / F.col("all_docs")).alias("quantile"))
