"""Mixing and revisit resolution against plain Python."""
import hashlib
import math
from collections import Counter
from datetime import datetime, timedelta

import pytest


def test_mixing_counts(odd_docs, odd_rows, no_docs):
    from pricewise.llm import mixing as M
    for rate in (1.0, 40.0):
        out = M.replicate(odd_docs, total_rate=rate)
        assert out.columns == [*odd_docs.columns, "mix_copy", "mix_key"]
        rows = out.collect()
        got = Counter((r["doc_id"], r["text"]) for r in rows)
        size = Counter()
        for r in odd_rows:
            size[r["source"]] += len(r["text"] or "")
        weight = {s: v ** 0.7 for s, v in size.items() if v}
        want = Counter()
        for r in odd_rows:
            s = r["source"]
            lam = rate * weight[s] / sum(weight.values()) * sum(size.values()) / size[s] if size[s] else 0.0
            pieces = max(1, math.ceil(lam / M.PIECE))
            mean, n = lam / pieces, 0
            for j in range(1, pieces + 1):
                u = (int(hashlib.md5(f"17:{'null' if r['doc_id'] is None else r['doc_id']}:{j}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52
                cdf, k = math.exp(-mean), 0
                while cdf < u and k < M.TAIL:
                    k += 1
                    cdf += math.exp(-mean) * mean ** k / math.factorial(k)
                n += k
            if n:
                want[r["doc_id"], r["text"]] += n
        assert ([*(got - want)][:2], [*(want - got)][:2]) == ([], [])
    assert M.replicate(no_docs).count() == 0


def test_revisits(spark, monkeypatch):
    import random

    from pricewise.llm import revisits as R
    assert R.PERMITTED
    rnd, t0 = random.Random(2), datetime(2024, 1, 1)
    rows = []
    for i in range(400):
        kind = rnd.choice(["response", "revisit", "revisit"])
        url = rnd.choice(["http://a.org/x", "https://www.A.org/x/", "http://b.org/?b=1&a=2", "https://m.b.org:443/?a=2&b=1&utm_source=q#z", None])
        at = None if rnd.random() < 0.05 else t0 + timedelta(seconds=rnd.randint(0, 400))
        headers = None if rnd.random() < 0.1 else {"ETag": rnd.choice(["1", "W/1", "2"]), "Server": f"s{i}", "date": f"d{i}"}
        rows.append((i, kind, url, at, rnd.choice([200, 200, 404]) if kind == "response" else 304, headers, None, "extra"))
    rows.append(rows[-1])
    f = spark.createDataFrame(rows, "record_id bigint, kind string, url string, at timestamp, status int, headers map<string,string>, digest string, key string").repartition(3)
    key = {None: None, "http://a.org/x": "a.org/x", "https://www.A.org/x/": "a.org/x"}
    canon = lambda u: key[u] if u in key else "b.org/?a=2&b=1"
    want = Counter()
    for i, kind, url, at, _, h, _, _ in rows:
        if kind != "revisit":
            continue
        h = {k.lower(): v for k, v in (h or {}).items()}
        found = max(((x[3], x[0]) for x in rows if x[1] == "response" and x[4] == 200 and x[2] and canon(x[2]) == canon(url) and x[3] and at and x[3] <= at), default=None)
        if url is None:
            want[i, "no_url", None, None] += 1
        elif at is None:
            want[i, "no_time", None, None] += 1
        elif found is None:
            want[i, "no_earlier", None, None] += 1
        else:
            g = {k.lower(): v for k, v in (rows[found[1]][5] or {}).items()}
            bare = lambda x: x["etag"].removeprefix("W/") if "etag" in x else None
            if bare(h) and bare(g) and bare(h) != bare(g):
                want[i, "changed", None, None] += 1
            else:
                merged = g | {k: v for k, v in h.items() if k in R.PERMITTED}
                want[i, "resolved", found[1], tuple(sorted(merged.items()))] += 1
    for block in (60, 86_400):
        got = Counter((r["record_id"], r["outcome"], r["resolved_id"], None if r["headers"] is None else tuple(sorted(r["headers"].items()))) for r in R.resolve(f, block).collect())
        assert ([*(got - want)][:2], [*(want - got)][:2]) == ([], [])
    assert R.resolve(f.where("false")).count() == 0


@pytest.mark.parametrize("url,want", [("HTTP://User@WWW.Ex.org:80/a/?sid=3", "ex.org/a"), ("https://ex.org", "ex.org/"), ("ex.org/b?z=1&y=2&", "ex.org/b?y=2&z=1")])
def test_canonical_url(spark, url, want):
    from pricewise.llm.revisits import canonical_url
    d = spark.createDataFrame([(url,)], "u string")
    assert d.select(canonical_url(d.u)).first()[0] == want
