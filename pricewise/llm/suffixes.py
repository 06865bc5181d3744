"""Suffix-array dedup: bytes that repeated windows of fixed width cover are removed.

A suffix counts only through its first ``width`` bytes, so suffixes that agree that far are the
repeated windows.  Groups are refined by most-significant-digit passes, and a pass drops what stands
alone.  The first digit must be one that equal windows share and that few rows carry, so it is the
window's anchor: the GRAM bytes with the least hash among all in it (leftmost of equals).  Neighbouring
suffixes with the same anchor travel as one run.
  pass 1  anchors found once are dropped;
  pass 2  runs that agree in all bytes of all their windows are repeated as a whole;
  pass 3  where an anchor has several such texts, one run of each is cut into blocks of up to STEP
          suffixes, aligned to the anchor; the digit is the bytes that all suffixes of a block share,
          so suffixes of a block that stands alone are not repeated;
  pass 4  the blocks that are left are opened into single suffixes, and the digit is the rest of their
          bytes: what stands alone there is not repeated.
All passes are aggregations with partial sums, so a window with a third of all places is one row per
task.  Places are judged on the input; overlaps count; matches never cross documents.

Defined cases: null text = empty text; texts shorter than the width keep everything; repeated rows
repeat each other and lose all windows; null ids are ids; an empty table gives an empty result; other
columns are not read.  Windows are compared by two 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewise.llm.common import Rolling, keep, may_hold, mix, python_ready, runs_of_texts, text_buffers, text_or_empty

GRAM = 64
STEP = 16
#: Bytes handled at once; places inside fit into the low bits of a packed hash.
BITS = 20
CHUNK = 1 << BITS
LOW = np.uint64(CHUNK - 1)


def _rolling(cache: list = []) -> Rolling:  # noqa: B006 - one per worker process
    if not cache:
        cache.append(Rolling(29))
    return cache[0]


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, in two accumulated passes."""
    n = len(x)
    pad = np.full(-n % w, np.iinfo(x.dtype).max, x.dtype)
    y = np.concatenate([x, pad]).reshape(-1, w)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - w + 1], ahead[w - 1:n])


def runs(data: np.ndarray, starts: np.ndarray, width: int):
    """Runs of windows with one anchor in a buffer of texts (``starts``: their bounds).

    Returns text index, place of the first window, number of windows, anchor's distance, hashes of anchor and context."""
    roll, n = _rolling(), len(data)
    none = np.zeros(0, np.int64)
    if n < width:
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    sums = roll.sums(data)
    at = np.arange(n - GRAM + 1)
    gram = mix(roll.spans(sums, at, at + GRAM))
    anchor = (sliding_least((gram & ~LOW) | at.astype(np.uint64), width - GRAM + 1) & LOW).astype(np.int64)
    place = np.arange(n - width + 1)
    text = np.searchsorted(starts, place, side="right") - 1
    place = place[place + width <= starts[text + 1]]
    if not len(place):
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    text, anchor = text[place], anchor[place]
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (place[1:] != place[:-1] + 1)]))
    count = np.diff(np.append(new, len(place)))
    first = place[new]
    context = mix(roll.spans(sums, first, first + count - 1 + width) + count.astype(np.uint64))
    return text[new], first, count, anchor[new] - first, gram[anchor[new]], context


def chunks(column, width: int):
    """(index of the first text, bytes, bounds, offset inside that text) of an Arrow column; long texts in overlapping pieces."""
    raw, off = text_buffers(column)
    for a, b in runs_of_texts(off, CHUNK):
        size = int(off[b] - off[a])
        if size <= CHUNK:
            yield a, raw[off[a]:off[b]], off[a:b + 1] - off[a], 0
        else:
            for x in range(0, size - width + 1, CHUNK - width + 1):
                piece = raw[off[a] + x:min(off[a] + x + CHUNK, off[b])]
                yield a, piece, np.array([0, len(piece)]), x


def all_runs(docs: DataFrame, width: int) -> DataFrame:
    """k, first, count, dist, anchor, context of every run of every text (docs: k, text)."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            k = b.column(0).to_numpy(zero_copy_only=False)
            for i, data, starts, base in chunks(b.column(1), width):
                text, first, count, dist, anchor, context = runs(data, starts, width)
                yield pa.RecordBatch.from_arrays([pa.array(k[i + text]), pa.array((first - starts[text] + base if len(text) else first).astype(np.int64)), pa.array(count.astype(np.int32)), pa.array(dist.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(context.view(np.int64))], names=["k", "first", "count", "dist", "anchor", "context"])

    return docs.mapInArrow(run, "k bigint, first bigint, count int, dist int, anchor bigint, context bigint")


def blocks(docs: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """The asked runs (k, first, count, dist, anchor) in blocks: lead and core (digits), left and right (the bytes
    beside the core), k, at (place of the last suffix), lo and hi (its suffixes are at - hi .. at - lo)."""
    lists = asked.groupBy("k").agg(F.collect_list(F.struct("first", "count", "dist", "anchor")).alias("runs"))
    some = may_hold(docs, "k", asked.select("k"), "asked").where("asked").drop("asked")

    def run(batches):
        import pyarrow as pa

        roll, more = _rolling(), STEP - 1
        for b in batches:
            raw, off = text_buffers(b.column(1))
            for j, k in enumerate(b.column(0).to_pylist()):
                data = raw[off[j]:off[j + 1]]
                out: list[tuple] = []
                cores, leads = [], []
                for r in b.column(2)[j].values.to_pylist():
                    x, n, dist = r["first"], r["count"], r["dist"]
                    sums = roll.sums(data[x:x + n - 1 + width])
                    number = np.arange((dist - n + 1) // STEP, dist // STEP + 1)
                    at = x + dist - STEP * number
                    cores.append(mix(roll.spans(sums, at - x, at - x + width - more)) if n else np.zeros(0, np.uint64))
                    leads.append(mix(np.full(len(number), r["anchor"], np.int64).view(np.uint64) + number.astype(np.uint64)))
                    for c, p in zip(number.tolist(), at.tolist()):
                        out.append((data[max(0, p - more):p].tobytes(), data[p - more + width:p + width].tobytes(), p, max(0, dist - n + 1 - STEP * c), min(more, dist - STEP * c)))
                left, right, at, lo, hi = zip(*out)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(leads).view(np.int64)), pa.array(np.concatenate(cores).view(np.int64)), pa.array(left, pa.binary()), pa.array(right, pa.binary()),
                    pa.array(np.full(len(at), k, np.int64)), pa.array(at, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], names=["lead", "core", "left", "right", "k", "at", "lo", "hi"])

    return some.join(lists, "k").select("k", "text", "runs").mapInArrow(run, "lead bigint, core bigint, left binary, right binary, k bigint, at bigint, lo int, hi int")


def repeated(docs: DataFrame, width: int) -> DataFrame:
    """k, marks of every text with repeated windows (docs: k, text): (kind, first, last) of window places - kind 0:
    may be repeated, 1: stands alone, 2: is repeated; the larger kind holds."""
    every = keep(all_runs(docs, width), "runs")
    # Each list of repeated keys is a table of its own: a join with a key that a third of the rows carry can then be split.
    twice = keep(every.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "twice")
    left = keep(every.join(twice, "anchor"), "left")
    same = ["anchor", "dist", "count", "context"]
    texts = keep(left.groupBy(*same).agg(F.count("*").alias("n"), F.min(F.struct("k", "first")).alias("one")), "texts")
    several = keep(texts.groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1").select("anchor"), "several")
    asked = texts.join(several, "anchor").select("one.k", "one.first", "count", "dist", "anchor")
    block = keep(blocks(docs, asked, width), "blocks")
    repeats = keep(block.groupBy("lead", "core").agg(F.count("*").alias("n")).where("n > 1").select("lead", "core"), "repeats")
    block = keep(block.join(repeats, ["lead", "core"]), "alike")
    j = F.col("j")
    one = block.select("lead", "core", "left", "right", "k", "at", F.explode(F.sequence("lo", "hi")).alias("j"))
    rest = F.concat(F.when(j > 0, F.substring("left", -j, j)).otherwise(F.lit(b"")), F.substring("right", F.lit(1), F.lit(STEP - 1) - j))
    alone = one.groupBy("lead", "core", "j", rest.alias("rest")).agg(F.count("*").alias("n"), F.first(F.struct("k", (F.col("at") - j).alias("place"))).alias("one")).where("n = 1")
    whole = left.join(texts.where("n > 1").select(*same), same)
    mark = lambda kind, first, last: F.struct(F.lit(kind).alias("kind"), first.alias("first"), last.alias("last")).alias("mark")
    marks = (block.select("k", mark(0, F.col("at") - F.col("hi"), F.col("at") - F.col("lo")))
             .unionByName(alone.select("one.k", mark(1, F.col("one.place"), F.col("one.place"))))
             .unionByName(whole.select("k", mark(2, F.col("first"), F.col("first") + F.col("count") - 1))))
    return marks.groupBy("k").agg(F.array_sort(F.collect_set("mark")).alias("marks"))


def remove_repeats(docs: DataFrame, width: int = 400) -> DataFrame:
    """doc_id, n_bytes, spans (start, end of removed bytes), kept (the bytes that stay) for every document."""
    python_ready(docs.sparkSession)
    d = docs.select("doc_id", text_or_empty("text").alias("text")).withColumn("k", F.xxhash64("doc_id", "text"))
    found = keep(repeated(d.select("k", "text"), width), "marks")
    x = may_hold(d, "k", found.select("k"), "some")
    untouched = x.where("not some").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("spans"), F.col("text").cast("binary").alias("kept"))
    x = x.where("some").join(found, "k", "left").select("doc_id", "text", "marks")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            raw, off = text_buffers(b.column(1))
            spans, kept = [], []
            for j in range(len(b)):
                data = raw[off[j]:off[j + 1]]
                places = b.column(2)[j]
                if not places.is_valid:
                    spans.append([])
                    kept.append(data.tobytes())
                    continue
                kind, first, last = (places.values.field(n).to_numpy(zero_copy_only=False) for n in ("kind", "first", "last"))
                again = np.zeros(len(data), bool)
                for t, a, z in zip(kind.tolist(), first.tolist(), last.tolist()):  # by kind
                    again[a:z + 1] = t != 1
                total = np.concatenate([[0], np.cumsum(again)])
                covered = total[1:] > total[np.maximum(np.arange(len(data)) + 1 - width, 0)]
                edge = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
                spans.append([{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2])])
                kept.append(data[~covered].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(off)), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return x.mapInArrow(run, "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary").unionByName(untouched)


def removal_digests(docs: DataFrame, width: int = 400) -> DataFrame:
    x = remove_repeats(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), width)
    return x.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
