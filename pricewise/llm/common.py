"""Helpers shared by the operators of this package."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewise.session import shared_path, shuffles_dropped

#: Bytes of text per Arrow batch handed to Python; long documents then come a few at a time.
ARROW_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


#: Tables that ``keep`` has written and ``release`` has not removed, oldest first.
KEPT: list[str] = []


def keep(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet in the cluster's shared folder and read it back: cuts the lineage,
    so that a lost executor costs one read and no recomputation.  ``release`` removes such tables; the shuffle files go
    with the write."""
    spark = df.sparkSession
    path = shared_path(spark, "llm", what, unique=True)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    KEPT.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Remove tables of ``keep`` once what was made from them is itself written."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        KEPT.remove(path)


def python_ready(spark: SparkSession, most: int = ARROW_BYTES) -> None:
    """Before work in Python: send the code, and bound Arrow batches by bytes as well as by rows (unless the session has a lower bound)."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("b")
    if not now.isdigit() or int(now) > most:
        spark.conf.set(key, f"{most}b")


#: Bits of the filter below, held as 2 ** (FILTER_BITS - 6) rows of 16 bytes: 4 MB, whatever the keys.
FILTER_BITS = 24


def may_hold(df: DataFrame, key: str, keys: DataFrame, name: str) -> DataFrame:
    """Adds ``name``: false only where ``key`` (long) is not among ``keys``.  A filter of fixed size, so that a join
    moves few rows that find no partner; with very many keys it passes more rows and changes no result."""
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << FILTER_BITS))
    words = keys.select(F.shiftright(bit(key), 6).alias("fw"), F.pmod(bit(key), F.lit(64)).cast("int").alias("fb")).groupBy("fw").agg(F.bit_or(F.expr("shiftleft(1L, fb)")).alias("fbits"))
    x = df.withColumn("fw", F.shiftright(bit(key), 6)).join(F.broadcast(words), "fw", "left")
    test = F.coalesce(F.getbit("fbits", F.pmod(bit(key), F.lit(64)).cast("int")) == 1, F.lit(False))
    return x.withColumn(name, test).drop("fw", "fbits")


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of an Arrow string column; a null is an empty text."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def runs_of_texts(offsets: np.ndarray, most: int):
    """(first, last) of texts that together hold at most ``most`` bytes; a longer text comes alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Rolling:
    """Polynomial hashes (mod 2**64, odd base, random byte values) of any substring of a buffer by prefix sums."""

    def __init__(self, seed: int, fold_case: bool = False):
        made = mix(np.arange(1, 258, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        self.values = made[:256]
        if fold_case:
            self.values[65:91] = self.values[97:123]
        base = (int(made[256]) << 3 | 5) & ((1 << 64) - 1)
        self.base, self.back = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.zeros(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) >= n:
            return

        def powers(b: int) -> np.ndarray:
            out = np.ones(1, np.uint64)
            while len(out) < n:
                out = np.concatenate([out, out * np.uint64(pow(b, len(out), 1 << 64))])
            return out
        self.up, self.down = powers(self.base), powers(self.back)

    def sums(self, data: np.ndarray) -> np.ndarray:
        """Prefix sums: element i covers data[:i]."""
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[:len(data)], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (sums[ends] - sums[starts]) * self.down[starts]


def ship(spark: SparkSession) -> None:
    """Give the executors this package: they need not share the driver's import path.  Once per application."""
    import os
    import tempfile
    import zipfile

    import pricewise

    sc = spark.sparkContext
    if getattr(sc, "_pricewise_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(pricewise.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="pricewise-code-"), "pricewise_code.zip")  # the driver's own copy; Spark sends it on
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("pricewise", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._pricewise_shipped = True
