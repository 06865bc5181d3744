"""Periodic run detection: stretches of words that repeat with a period, and the text without the repeats.

Method: Baier's grouping.  Phase one of his suffix sorter puts suffixes into groups by their longest Lyndon
prefix: groups start as equal words, are taken from the highest down, and each taken group of prefix u gives
every nearest lower position j to its left the prefix v u..u, which moves j to a new group right above its
old one.  When a group is taken its prefix length is the Lyndon array at its places.  Done under an order of
the words and under the reverse order, the two arrays hold a Lyndon root of every run; roots are extended to
both sides by longest common extensions (binary search over prefix-sum hashes), and every run that comes out
is compared word by word.

A run of 12 words or more with two periods or more holds only words that lie in a window of six words found
twice in the text (max(p, 12 - p) >= 6 words in a row agree at distance p).  So the grouping is
done on the stretches which such windows cover; every run lies inside one stretch, and none is lost.

Words are compared exactly as they stand, by numbers given to the words of a batch.  One document's numbers are one
worker's work, bounded by the longest text; nothing is shuffled.

Defined cases: null or empty text or no word = no run and the empty text; equal words at all places = one run
of period one; runs that touch text ends are runs; repeated rows and null ids are reported each for itself;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewise.llm.common import Rolling, mix, python_ready, runs_of_texts, text_buffers

#: A run has so many words and two periods at least.
LEAST = 12
GROUP_BYTES = 1 << 20


def lyndon_lengths(s: list[int], m: int) -> list[int]:
    """The length of the longest Lyndon word at each place of ``s`` (numbers 0 .. m - 1), by Baier's phase one."""
    n = len(s)
    out = [0] * n
    # Groups are a linked list by order; group 0 stands above all.  A group's prefix ends where the next open place is.
    members: list[list[int]] = [[] for _ in range(m + 1)]
    group_of = [c + 1 for c in s]
    for i, g in enumerate(group_of):
        members[g].append(i)
    live = list(map(len, members))
    below, above = [m, -1, *range(1, m)], [0, *range(2, m + 1), 0]
    # Open places (in groups not taken yet) as a linked list; the last entry takes what falls off the ends.
    before, after = list(range(-1, n)), [*range(1, n + 1), 0]
    group = m
    while group > 0:
        if live[group] == 1:
            taken = members[group]
            i = taken[0] if len(taken) == 1 else next(i for i in taken if group_of[i] == group)
            j, k = before[i], after[i]
            out[i] = k - i
            before[k], after[j] = j, k
            if j >= 0 and live[v := group_of[j]] > 1:
                g = group_of[j] = len(members)
                members.append([j])
                live.append(1)
                live[v] -= 1
                a = above[v]
                below.append(v)
                above.append(a)
                above[v] = below[a] = g
        elif live[group]:
            taken = members[group]
            if live[group] < len(taken):
                taken = [i for i in taken if group_of[i] == group]
            counts: dict[int, int] = {}
            for i in taken:  # from left to right: the nearest open place to the left is in a lower group
                j, k = before[i], after[i]
                out[i] = k - i
                before[k], after[j] = j, k
                if j >= 0:
                    counts[j] = counts.get(j, 0) + 1
            made: dict[int, dict[int, int]] = {}
            for j, k in counts.items():
                v = group_of[j]
                new = made.get(v)
                if new is None:
                    if live[v] == 1:  # alone in its group: the prefix grows where it is
                        continue
                    new = made[v] = {}
                live[v] -= 1
                g = new.get(k)
                if g is None:
                    g = new[k] = len(members)
                    members.append([j])
                    live.append(1)
                    below.append(0)
                    above.append(0)
                else:
                    members[g].append(j)
                    live[g] += 1
                group_of[j] = g
            for v, new in made.items():  # above their parent; more copies are higher
                a, low = above[v], v
                for k in sorted(new):
                    g = new[k]
                    below[g], above[low] = low, g
                    low = g
                above[low], below[a] = a, low
        group = below[group]
    return out


def stretches(ids: np.ndarray, doc: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches that windows found twice in their text cover (ids: all words of some texts)."""
    w, n = max(1, least // 2), len(ids)
    none = np.zeros(0, np.int64)
    if n < least:
        return none, none
    word, factor = mix(ids.astype(np.uint64)), mix(np.arange(301, 301 + w, dtype=np.uint64)) | np.uint64(1)
    h = mix(doc[:n - w + 1].astype(np.uint64))
    for t in range(w):
        h = h + word[t:n - w + 1 + t] * factor[t]
    place = np.flatnonzero(bounds[doc[:n - w + 1] + 1] - np.arange(n - w + 1) >= w)
    h = h[place]
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    edge[place[twice]] += 1
    edge[place[twice] + w] -= 1
    covered = np.cumsum(edge[:-1]) > 0
    new_text = np.ones(n, bool)
    new_text[1:] = doc[1:] != doc[:-1]
    starts = np.flatnonzero(covered & (new_text | ~np.concatenate([[False], covered[:-1]])))
    ends = np.flatnonzero(covered & np.concatenate([new_text[1:] | ~covered[1:], [True]])) + 1
    long = ends - starts >= least
    return starts[long], ends[long]


def common(sums: np.ndarray, roll: Rolling, i: np.ndarray, j: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """Words that agree from i and j on (step 1) or before them (step -1), at most ``most``, by hashes."""
    low, high = np.zeros(len(i), np.int64), most.copy()
    while (open_ := low < high).any():
        mid = (low + high + 1) // 2
        x, y = (i, j) if step > 0 else (i - mid, j - mid)
        equal = roll.spans(sums, x, x + mid) == roll.spans(sums, y, y + mid)
        low, high = np.where(open_ & equal, mid, low), np.where(open_ & ~equal, mid - 1, high)
    return low


def common_plain(ids: np.ndarray, i: int, j: int, most: int, step: int) -> int:
    a, b = (ids[i:i + most], ids[j:j + most]) if step > 0 else (ids[i - most:i][::-1], ids[j - most:j][::-1])
    differ = np.flatnonzero(a != b)
    return int(differ[0]) if len(differ) else most


def runs(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int, cache: list = []) -> np.ndarray:  # noqa: B006 - one per worker process
    """Rows (start, end, period) of all runs inside the stretches of ``ids``, by start and period."""
    if not cache:
        cache.append(Rolling(37))
    roll, from_, root, lo, hi = cache[0], [], [], [], []
    for a, b in zip(starts.tolist(), ends.tolist()):
        values, s = np.unique(ids[a:b], return_inverse=True)
        for one in (s, len(values) - 1 - s):
            from_.append(np.arange(a, b))
            root.append(np.array(lyndon_lengths(one.tolist(), len(values)), np.int64))
            lo.append(np.full(b - a, a))
            hi.append(np.full(b - a, b))
    if not from_:
        return np.zeros((0, 3), np.int64)
    i, p, lo, hi = (np.concatenate(x) for x in (from_, root, lo, hi))
    some = i + p < hi
    i, p, lo, hi = (x[some] for x in (i, p, lo, hi))
    j = i + p
    # Most roots agree with nothing beside them: the words next to i and j decide before any search.
    ahead = ids[i] == ids[j]
    back = (i > lo) & (ids[i - 1] == ids[j - 1])
    some = ahead | back
    i, p, lo, hi, j = (x[some] for x in (i, p, lo, hi, j))
    roll._grow(len(ids) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(ids.astype(np.uint64) + np.uint64(1)) * roll.up[:len(ids)])])
    right, left = common(sums, roll, i, j, hi - j, 1), common(sums, roll, i, j, i - lo, -1)

    def kept(left, right):
        start, end = i - left, j + right
        some = end - start >= np.maximum(least, 2 * p)
        return np.unique(np.stack([start[some], p[some], end[some]], axis=1), axis=0)

    found = kept(left, right)
    if not all(np.array_equal(ids[s:e - q], ids[s + q:e]) for s, q, e in found.tolist()):  # two hashes met: word by word
        at = list(zip(i.tolist(), j.tolist(), lo.tolist(), hi.tolist()))
        found = kept(np.array([common_plain(ids, x, y, x - a, -1) for x, y, a, _ in at]), np.array([common_plain(ids, x, y, b - y, 1) for x, y, _, b in at]))
    return found[:, [0, 2, 1]]


def looped(doc_id: int | None, n: int) -> np.ndarray | None:
    """For a tenth of the ids (by their CRC-32), places that repeat a text's words with a period; else None."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    place[a:] = a + (place[a:] - a) % p
    return place


def periodic_runs(docs: DataFrame, least: int = LEAST, rearrange=None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; word numbers from 0) and collapsed (text of the words that no run repeats).

    ``rearrange`` (doc_id, number of words) may give the places of the words to take, in order; None: all as they are."""
    python_ready(docs.sparkSession)
    kind = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary"

    def run(batches):
        import pyarrow as pa

        shape = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        for b in batches:
            keys = b.column(0).to_pylist()
            raw, off = text_buffers(b.column(1))
            for x, y in runs_of_texts(off, GROUP_BYTES):
                number: dict[bytes, int] = {}
                texts, ids = [], []
                for d in range(x, y):
                    words = raw[off[d]:off[d + 1]].tobytes().split()
                    place = rearrange(keys[d], len(words)) if rearrange else None
                    if place is not None:
                        words = [words[t] for t in place.tolist()]
                    texts.append(words)
                    ids.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
                bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
                every = np.concatenate(ids)
                doc = np.repeat(np.arange(y - x), np.diff(bounds))
                found = runs(every, *stretches(every, doc, bounds, least), least)
                owner = doc[found[:, 0]] if len(found) else np.zeros(0, np.int64)
                cut = np.searchsorted(owner, np.arange(y - x + 1))
                edge = np.zeros(len(every) + 1, np.int64)
                np.add.at(edge, found[:, 0] + found[:, 2], 1)
                np.add.at(edge, found[:, 1], -1)
                stay = np.cumsum(edge[:-1]) == 0
                rows, collapsed = [], []
                for d, words in enumerate(texts):
                    mine = found[cut[d]:cut[d + 1]]
                    rows.append([{"start": s - int(bounds[d]), "length": e - s, "period": q} for s, e, q in mine.tolist()])
                    if len(mine):
                        words = [words[t] for t in np.flatnonzero(stay[bounds[d]:bounds[d + 1]]).tolist()]
                    collapsed.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(x, y - x), pa.array([len(t) for t in texts], pa.int64()), pa.array(rows, shape), pa.array(collapsed, pa.binary())], names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kind)


def run_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli) and digests of all runs and of the collapsed text."""
    x = periodic_runs(docs, rearrange=looped)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    said = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return x.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.p")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.p")).alias("exponent_milli"),
        F.sha2(F.concat(said, F.when(F.size("runs") > 0, "\n").otherwise("")).cast("binary"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
