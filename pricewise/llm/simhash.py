"""SimHash near-dedup: documents whose fingerprints differ in few bits, and the classes that links make.

A fingerprint bit is set if over half of a document's shingle hashes (XXH64, repeats included) have it set.

Method: bit-sliced comparison.  The fingerprints of a block are stored as 64 vertical planes, one 64-bit
word for 64 lanes; a plane is compared with a bit of a fingerprint by one exclusive or, carry-save adders
count the differing bits of all 64 lanes at once in three counter planes, and after every eight planes the
words in which all lanes exceed the radius are abandoned.

Which fingerprints meet in a block: the 64 bits are cut into ``radius + 2`` bands, so two fingerprints that
link agree in two bands at least, and all that agree in the same two bands are a bucket.  Small buckets
share blocks (a link found between two buckets is a link all the same).  In a bucket of more than BLOCK
fingerprints those that differ in one bit are linked first, by equal fingerprints without that bit (linear
work); what then is in the bucket's largest class need not be compared with itself, and the rest is
compared in pairs of blocks.  A block returns a spanning forest of what it links, not all pairs.  So every
link between different fingerprints is kept up to reachability, and no task holds more than a few blocks.

Defined cases: null or empty text or no word = fingerprint zero, linked like any other; fewer words than a
shingle = one shingle of all words; A-Z is folded, nothing else; repeated rows and equal texts are in one
class; a null id never names a class unless no member has an id; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewise.llm.common import keep, python_ready, text_buffers
from pricewise.llm.components import components

SEED = 42
#: Fingerprints of a block, and the largest bucket that is one block's work.
BLOCK = 512
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
ITEM = 1 << 16


def fingerprint(data: bytes, words: int) -> int:
    """64 majority bits of the hashes of a text's shingles."""
    from xxhash import xxh64_intdigest

    w = data.lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) <= words:
        return xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts = (ends - np.fromiter(map(len, w), np.int64, len(w)) - 1)[:len(w) - words + 1].tolist()
    h = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, (ends[words - 1:] - 1).tolist())], "<u8")
    counts = np.zeros(64, np.int64)
    for a in range(0, len(h), ITEM):
        counts += np.unpackbits(h[a:a + ITEM].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, fp (long with the fingerprint's bits) of every document."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            raw, off = text_buffers(b.column(1))
            fp = np.array([fingerprint(raw[off[i]:off[i + 1]].tobytes(), words) for i in range(len(b))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


def planes(fp: np.ndarray) -> np.ndarray:
    """Bit planes: word w of plane b holds bit b of the fingerprints 64 w .. 64 w + 63."""
    bits = np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    bits = np.pad(bits, ((0, 0), (0, -len(fp) % 64)))
    return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view("<u8")


def add(a, b, c):
    """Carry-save adder: the sum and the carry of three planes."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def exceeds(ones, twos, fours, over, radius: int):
    """Lanes whose count is over the radius (at most 7)."""
    more, same = over.copy(), ~over
    for counter, bit in ((fours, 4), (twos, 2), (ones, 1)):
        if radius & bit:
            same = same & counter
        else:
            more |= same & counter
            same = same & ~counter
    return more


def near_pairs(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (in left, in right) of fingerprints within the radius; with right None, pairs i < j in left."""
    other = left if right is None else right
    plane = planes(other)
    bit = np.where(np.unpackbits(left.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T == 1, ALL, np.uint64(0))
    n, w = len(left), plane.shape[1]
    row, word = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(w), indexing="ij"))
    if right is None:
        row, word = row[word >= row // 64], word[word >= row // 64]
    over = np.zeros(len(row), np.uint64)
    if len(other) % 64:
        over[word == w - 1] = ALL << np.uint64(len(other) % 64)
    if right is None:
        own = word == row // 64
        over[own] |= ALL >> (np.uint64(63) - (row[own] % 64).astype(np.uint64))
    ones, twos, fours = (np.zeros(len(row), np.uint64) for _ in range(3))
    for b in range(0, 64, 8):
        d = [plane[k][word] ^ bit[k][row] for k in range(b, b + 8)]
        ones, a = add(ones, d[0], d[1])
        ones, c = add(ones, d[2], d[3])
        twos, e = add(twos, a, c)
        ones, a = add(ones, d[4], d[5])
        ones, c = add(ones, d[6], d[7])
        twos, f = add(twos, a, c)
        fours, eights = add(fours, e, f)
        over = exceeds(ones, twos, fours, over | eights, radius)
        alive = over != ALL
        if not alive.all():
            row, word, ones, twos, fours, over = (x[alive] for x in (row, word, ones, twos, fours, over))
            if not len(row):
                break
    hit, lane = np.nonzero(np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return row[hit], word[hit] * 64 + lane


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place that links reach, for each of n places."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def block_links(tiles: DataFrame, radius: int) -> DataFrame:
    """a, b: links between fingerprints.  tiles: left, right (arrays of fp; right null: left against itself)."""
    def run(batches):
        import pyarrow as pa

        def found(left, right):
            i, j = near_pairs(left, right, radius)
            every = left if right is None else np.concatenate([left, right])
            label = forest(len(every), i, j if right is None else j + len(left))
            at = np.flatnonzero(label != np.arange(len(every)))
            return pa.RecordBatch.from_arrays([pa.array(every[at].view(np.int64)), pa.array(every[label[at]].view(np.int64))], names=["a", "b"])

        waiting, size = [], 0
        for batch in batches:
            for left, right in zip(batch.column(0), batch.column(1)):
                x = left.values.to_numpy().view(np.uint64)
                if right.is_valid:
                    yield found(x, right.values.to_numpy().view(np.uint64))
                    continue
                if size and size + len(x) > BLOCK:
                    yield found(np.concatenate(waiting), None)
                    waiting, size = [], 0
                waiting.append(x.copy())
                size += len(x)
        if waiting:
            yield found(np.concatenate(waiting), None)

    return tiles.select("left", "right").mapInArrow(run, "a bigint, b bigint")


def bucket_keys(radius: int):
    """Every two bands' bits with the number of the two, as a long each."""
    bands = radius + 2
    cut = [64 * i // bands for i in range(bands + 1)]
    part = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cut, cut[1:])]
    size = [b - a for a, b in zip(cut, cut[1:])]
    return [(F.shiftleft(F.shiftleft(F.lit(t).cast("long"), size[i]).bitwiseOR(part[i]), size[j]).bitwiseOR(part[j])) for t, (i, j) in enumerate(combinations(range(bands), 2))]


def near_links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """a, b: links that connect all fingerprints within ``radius`` bits (1 to 7) of each other.  fps: distinct fp."""
    if not 1 <= radius <= 7:
        raise ValueError("a radius of 1 to 7 bits is needed")
    rows = keep(fps.select("fp", F.explode(F.array(*bucket_keys(radius))).alias("bucket")), "buckets")
    sizes = keep(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    rows = rows.join(sizes, "bucket")
    small = rows.where(F.col("n") <= BLOCK).groupBy("bucket").agg(F.collect_list("fp").alias("left")).select("left", F.lit(None).cast("array<bigint>").alias("right"))
    found = block_links(small, radius)

    hot = keep(rows.where(F.col("n") > BLOCK).select("bucket", "fp"), "hot")
    inside = hot.select("fp").distinct()
    masked = inside.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(~(1 << b) if b < 63 else (1 << 63) - 1)) for b in range(64)])).alias("bit", "rest"))
    least = masked.groupBy("bit", "rest").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b")
    ones = keep(least.select("a", "b"), "ones")
    classes = components(ones)
    hot = keep(hot.join(classes, hot["fp"] == classes["node"], "left").select("bucket", "fp", F.coalesce("label", "fp").alias("label")), "labelled")
    main = hot.groupBy("bucket", "label").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("top"))
    parts = main.select("bucket", "top.label", F.ceil(F.col("top.n") / BLOCK).alias("same"), F.ceil((F.col("n") - F.col("top.n")) / BLOCK).alias("rest")).where("rest > 0")
    at = F.pmod(F.xxhash64("fp"), F.when(F.col("x.label") == F.col("p.label"), F.col("same")).otherwise(F.col("rest")))
    dealt = hot.alias("x").join(parts.alias("p"), "bucket").select("bucket", "fp", (F.col("x.label") == F.col("p.label")).alias("top"), "same", "rest", at.alias("at"))
    # Tiles: rest block i with rest block j >= i, and rest block i with each block of the top class.
    tile = F.when(F.col("top"), F.transform(F.sequence(F.lit(0).cast("long"), F.col("rest") - 1), lambda i: F.struct(i.alias("i"), (F.col("rest") + F.col("at")).alias("j"), F.lit(1).alias("side")))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("rest") + F.col("same") - 1),
                    lambda o: F.struct(F.when(o < F.col("rest"), F.least(o, F.col("at"))).otherwise(F.col("at")).alias("i"), F.when(o < F.col("rest"), F.greatest(o, F.col("at"))).otherwise(o).alias("j"),
                                       F.when(o < F.col("at"), F.lit(1)).otherwise(F.lit(0)).alias("side"))))
    spread = dealt.select("bucket", "fp", F.explode(tile).alias("t")).groupBy("bucket", "t.i", "t.j").agg(
        F.collect_list(F.when(F.col("t.side") == 0, F.col("fp"))).alias("left"), F.collect_list(F.when(F.col("t.side") == 1, F.col("fp"))).alias("right"))
    tiles = spread.select("left", F.when(F.col("i") < F.col("j"), F.col("right")).alias("right")).where((F.size("left") > 0) & (F.coalesce(F.size("right"), F.lit(1)) != 0))
    return found.unionByName(ones).unionByName(block_links(tiles, radius))


def near_classes(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    python_ready(docs.sparkSession)
    every = keep(fingerprints(docs, words), "fingerprints")
    first = keep(every.groupBy("fp").agg(F.min("doc_id").alias("first")), "first")
    label = components(near_links(first.select("fp"), radius))
    linked = first.join(label, first["fp"] == label["node"])
    least = linked.groupBy("label").agg(F.min("first").alias("component_id"))
    named = linked.join(least, "label").select("fp", "component_id").unionByName(first.join(label, first["fp"] == label["node"], "left_anti").select("fp", F.col("first").alias("component_id")))
    return every.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
