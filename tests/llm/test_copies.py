"""Similarity, repeated windows, search and the pipeline against plain Python over all pairs."""
import hashlib
from collections import Counter

import numpy as np
import pytest


def plain_classes(rows, words, percent):
    sets = []
    for r in rows:
        w = (r["text"] or "").encode().lower().split()
        sets.append(frozenset(tuple(w[j:j + words]) for j in range(max(1, len(w) - words + 1))) if w else frozenset())
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            o = len(s & sets[j])
            if o and 100 * o >= percent * (len(s) + len(sets[j]) - o):
                up[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        least.setdefault(root(i), []).append(r["doc_id"])
    return [(r["doc_id"], len(sets[i]), min((d for d in least[root(i)] if d is not None), default=None)) for i, r in enumerate(rows)]


def near_copies(n, words=60):
    rnd = np.random.default_rng(4)
    base = [f"w{i}" for i in range(words)]
    out = []
    for i in range(n):
        t = list(base)
        for k in rnd.integers(0, words, rnd.integers(0, 3)):
            t[k] = f"x{rnd.integers(0, 1000)}"
        out.append((1000 + i, " ".join(t)))
    return out


def test_classes(odd_docs, odd_rows, no_docs):
    from pricewise.llm.jaccard import classes, one_of_each
    got = Counter(tuple(r) for r in classes(odd_docs, 4, 85).collect())
    want = Counter(plain_classes(odd_rows, 4, 85))
    assert ([*(got - want)][:2], [*(want - got)][:2]) == ([], [])
    stay = one_of_each(odd_docs)
    assert stay.columns == odd_docs.columns
    want = {d for d, _, c in plain_classes(odd_rows, 5, 80) if c == d}
    assert sorted(r["doc_id"] or -1 for r in stay.collect()) == sorted(d or -1 for d in want)
    assert classes(no_docs).count() == 0


def test_hot_groups_lose_no_link(spark, monkeypatch):
    """A group of near copies far over HOT, verified in many blocks."""
    from pricewise.llm import jaccard as J
    monkeypatch.setattr(J, "HOT", 5)
    monkeypatch.setattr(J, "BLOCK", 16)
    rows = near_copies(150) + [(5, None), (6, "")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    want = Counter(plain_classes([{"doc_id": a, "text": b} for a, b in rows], 4, 85))
    got = Counter(tuple(r) for r in J.classes(d, 4, 85).collect())
    assert ([*(got - want)][:2], [*(want - got)][:2]) == ([], [])


def test_components_of_a_path(spark):
    from pricewise.llm.components import components
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    assert {tuple(r) for r in components(e).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}
    assert components(e.where("false")).count() == 0


def test_removed_bytes(odd_docs, odd_rows, no_docs):
    from pricewise.llm.suffixes import removal_digests
    texts = [(r["doc_id"], (r["text"] or "").encode()) for r in odd_rows]
    times = Counter(hash(x[i:i + 400]) for _, x in texts for i in range(len(x) - 399))
    want = Counter()
    for d, x in texts:
        step = np.zeros(len(x) + 1, int)
        for i in range(len(x) - 399):
            if times[hash(x[i:i + 400])] > 1:
                step[i] += 1
                step[i + 400] -= 1
        gone = np.cumsum(step)[:-1] > 0
        runs = int((np.diff(np.concatenate([[0], gone])) == 1).sum())
        want[d, len(x), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(x, np.uint8)[~gone].tobytes()).hexdigest()] += 1
    got = Counter(tuple(r) for r in removal_digests(odd_docs).collect())
    assert ([*(got - want)][:2], [*(want - got)][:2]) == ([], [])
    assert removal_digests(no_docs).count() == 0


def test_long_texts_in_pieces(monkeypatch):
    """Runs of a text that is cut into pieces are the windows of the whole."""
    import pyarrow as pa

    from pricewise.llm import suffixes as S
    text = "".join(f"{i} " for i in range(3000))
    monkeypatch.setattr(S, "CHUNK", 4096)
    seen = Counter()
    for _, data, starts, base in S.chunks(pa.array([text]), 400):
        _, first, count, _, _, _ = S.runs(data, starts, 400)
        for a, n in zip(first, count):
            seen.update(range(base + a, base + a + n))
    assert seen == Counter(range(len(text) - 399))


@pytest.mark.parametrize("n,dim", [(700, 16), (3, 2)])
def test_search(spark, monkeypatch, n, dim):
    from pricewise.llm import topk as K
    monkeypatch.setattr(K, "ROWS", 100)
    monkeypatch.setattr(K, "QUERIES", 8)
    rnd = np.random.default_rng(n)
    v = np.round(rnd.normal(size=(n, dim)) * 0.3, 2).astype(np.float32)
    v[n // 3: n // 2] = v[0]  # ties
    rows = [(i, [float(x) for x in v[i]], "extra") for i in range(n)] + [(10_000, None, ""), (10_001, [1.0, None], ""), (10_002, [float("nan")] * dim, ""), (10_100, [float("inf")] * dim, ""), (None, [0.5] * dim, "")]
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, rank string").repartition(4)
    q = np.floor(v.astype(float) * 1024)
    want = {(i, r + 1, int(j), int(q[j] @ q[i])) for i in range(0, n, 20) for r, j in enumerate([j for j in np.lexsort((np.arange(n), -(q @ q[i]))) if j != i][:10])}
    assert {tuple(r) for r in K.neighbours(d, 10, 20).collect()} == want
    assert K.neighbours(d.where("false")).count() == 0


def test_pipeline(spark, odd_docs, tmp_path):
    import corpus_pipeline as C
    import public_tokenizers as P
    import sentencepiece
    odd_docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for i, (_, stage) in enumerate(C.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, i
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
    rows = [r.asDict() for r in C.run(spark, str(tmp_path)).collect()]
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r["doc_id"], r["text"]) for r in docs.collect()) and rows
    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for r in rows:
        assert r["ids"] == lib.encode(r["text"]) and r["decoded"] == lib.decode(r["ids"])


def test_one_of_each_with_repeated_and_missing_ids(spark):
    """Near copies that share an id, or have none, leave one document a class."""
    from pricewise.llm.jaccard import one_of_each
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (1, a + " x"), (2, a + " y"), (None, b), (None, b + " x"), (None, b + " y"), (None, "short"), (3, "short")]
    got = [tuple(r) for r in one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert sorted((i or 0, t[0]) for i, t in got) == [(0, "b"), (1, "a"), (3, "s")]
