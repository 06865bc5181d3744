"""Exact top-k search by inner product with dual cover trees.

Vectors are cut into blocks where they are read; each block of rows meets each block of queries in one
task, so nothing is gathered whole.  Both blocks are indexed by a cover tree: a node's children are a
farthest-first net of its points, each with its exact covering radius.  A pair of nodes is dropped
when <qc, c> + |qc| r + |c| rq + r rq, the most that any of its pairs can score, is under the worst
kth score of the node's queries; pairs are visited in order of that bound.  A task builds each tree once and
carries the kth scores of a block of queries from one block of rows to the next.  The best k per task are then
ranked over all tasks.  A net of at most NET points can end a level before the radius is halved: radii are
exact all the same, so bounds hold.

Components are floor(1024 * x), scores are exact integers (sums over 2**53 are an error).
Defined cases: vectors that are null or hold null or non-finite components take no part; ties go to
the smaller vec_id; rows of the query's own vec_id are no candidates, a repeated row of another id is
one more candidate; a repeated query id asks once, with its smallest vector; vectors of another length
are no candidates; null vec_id takes no part; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricewise.llm.common import python_ready

SCALE = 1024.0
ROWS, QUERIES = 2048, 1024
LEAF, NET = 32, 48
#: Blocks of queries whose trees and scores a task keeps.
HELD = 64


class Tree:
    """Points in tree order; nodes hold [a, b), centre, radius and children."""

    class Node:
        __slots__ = ("a", "b", "centre", "norm", "radius", "children")

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        self.points = points
        self.root = self._node(0, len(points))
        self.points = points[self.order]

    def _node(self, a: int, b: int) -> Tree.Node:
        top = Tree.Node()
        todo = [(top, a, b)]
        while todo:
            node, a, b = todo.pop()
            p = self.points[self.order[a:b]]
            node.a, node.b, node.centre = a, b, p.mean(axis=0)
            node.norm = float(np.sqrt(node.centre @ node.centre))
            far = np.sqrt(((p - node.centre) ** 2).sum(axis=1))
            node.radius, node.children = float(far.max()) * (1 + 1e-12), []
            if b - a <= LEAF or node.radius == 0:
                continue
            near, owner, n, i = np.full(b - a, np.inf), np.zeros(b - a, int), 0, int(far.argmax())
            while n < NET and (n < 2 or near.max() > node.radius / 2):
                d = np.sqrt(((p - p[i]) ** 2).sum(axis=1))
                closer = d < near
                near[closer], owner[closer] = d[closer], n
                n, i = n + 1, int(near.argmax())
                if near[i] == 0:
                    break
            by = np.argsort(owner, kind="stable")
            self.order[a:b] = self.order[a:b][by]
            cuts = a + np.searchsorted(owner[by], np.arange(n + 1))
            for x, y in zip(cuts[:-1], cuts[1:]):
                if y > x:
                    child = Tree.Node()
                    node.children.append(child)
                    todo.append((child, int(x), int(y)))
        return top


class Asked:
    """A block of queries: its tree, and the best k found so far for each query."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.tree, self.k = Tree(queries), k
        self.ids = ids[self.tree.order]
        self.best, self.who = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)

    def search(self, did: np.ndarray, d: Tree) -> None:
        """Take in the rows of another tree (``did``: their ids in tree order); what was found before prunes it."""
        def bound(x, y):
            return float(x.centre @ y.centre) + x.norm * y.radius + y.norm * x.radius + x.radius * y.radius + 1e-6 * (1 + x.norm * y.norm)

        q, qid, best, who = self.tree, self.ids, self.best, self.who
        todo = [(bound(q.root, d.root), q.root, d.root)]
        while todo:
            most, x, y = todo.pop()
            if most < best[x.a:x.b, -1].min():
                continue
            if y.children and (not x.children or y.radius >= x.radius):
                todo += sorted(((bound(x, c), x, c) for c in y.children), key=lambda t: t[0])
            elif x.children:
                todo += sorted(((bound(c, y), c, y) for c in x.children), key=lambda t: t[0])
            else:
                score = q.points[x.a:x.b] @ d.points[y.a:y.b].T
                score[qid[x.a:x.b, None] == did[None, y.a:y.b]] = -np.inf
                some = np.flatnonzero((score >= best[x.a:x.b, -1:]).any(axis=1)) + x.a  # the others keep what they have
                if not len(some):
                    continue
                score = score[some - x.a]
                s = np.concatenate([best[some], score], axis=1)
                w = np.concatenate([who[some], np.broadcast_to(did[y.a:y.b], score.shape)], axis=1)
                top = np.lexsort((w, -s), axis=1)[:, :self.k]
                best[some], who[some] = np.take_along_axis(s, top, 1), np.take_along_axis(w, top, 1)

    def found(self):
        """query_id, vec_id and score of what was found."""
        import pyarrow as pa

        ok = ~np.isneginf(self.best.ravel())
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, self.k)[ok]), pa.array(self.who.ravel()[ok]), pa.array(self.best.ravel()[ok].astype(np.int64))], names=["query_id", "vec_id", "score"])


def blocks(vectors: DataFrame, most: int) -> DataFrame:
    """Vectors (id, v: array of double) as rows (dim, ids, data) of up to ``most`` vectors each."""
    def run(batches):
        import pyarrow as pa

        held: dict[int, tuple[list, list]] = {}

        def out(dim):
            ids, data = held.pop(dim)
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([np.array(data, np.float64).tobytes()], pa.binary())], names=["dim", "ids", "data"])

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1)):
                x = np.floor(v.values.to_numpy(zero_copy_only=False) * SCALE)
                if len(x) and float(np.abs(x).max()) ** 2 * len(x) >= 2.0 ** 53:
                    raise OverflowError("scores over 2**53 are not supported")
                ids, data = held.setdefault(len(x), ([], []))
                ids.append(i)
                data.append(x)
                if len(ids) >= most:
                    yield out(len(x))
        for dim in list(held):
            yield out(dim)

    return vectors.mapInArrow(run, "dim int, ids binary, data binary")


def neighbours(embeddings: DataFrame, k: int = 10, every: int = 100, vec: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id is divisible by ``every``."""
    spark = embeddings.sparkSession
    python_ready(spark)
    v = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vec).cast("array<double>").alias("v"))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & whole)
    asked = v.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = blocks(v, ROWS).withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int"))
    # Every salt's blocks of rows meet all blocks of queries; rows travel once, queries once per salt.
    ask = blocks(asked, QUERIES).select("dim", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))

    def run(batches):
        held: dict[tuple, Asked] = {}  # the blocks of queries met last, with what was found for them
        last, did, tree = None, None, None
        for b in batches:
            for dim, ids, data, q_ids, q_data in zip(*(c.to_pylist() for c in b.columns)):
                if last != (dim, ids):  # a block of rows meets all blocks of queries before the next one comes
                    tree = Tree(np.frombuffer(data).reshape(len(ids) // 8, dim))
                    last, did = (dim, ids), np.frombuffer(ids, np.int64)[tree.order]
                asked = held.pop((dim, q_ids), None)
                if asked is None:
                    if len(held) >= HELD:
                        yield held.pop(next(iter(held))).found()
                    asked = Asked(np.frombuffer(q_ids, np.int64), np.frombuffer(q_data).reshape(len(q_ids) // 8, dim), k)
                held[dim, q_ids] = asked
                asked.search(did, tree)
        for asked in held.values():
            yield asked.found()

    # (a given number of partitions: few bytes, but much work, which must not be put together into fewer tasks)
    dealt = rows.repartition(salts, "dim", "salt").join(ask.repartition(salts, "dim", "salt").hint("merge"), ["dim", "salt"])
    found = dealt.select("dim", "ids", "data", "q_ids", "q_data").mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
