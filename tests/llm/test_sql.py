"""Registered queries against their SQL on odd tables: nulls, empty texts, ties, repeated rows."""
import math
from collections import Counter

import pytest

VECTORS = [(i, [math.sin(i * 7 + j) for j in range(8)], 0) for i in range(240)] + [(100, [0.5] * 8, 0), (7, [math.sin(49 + j) for j in range(8)], 0), (300, None, 0), (400, [None] * 8, 0),
           (500, [float("nan")] * 8, 0), (600, [float("inf")] * 8, 0), (None, [0.1] * 8, 0), (700, [0.1] * 3, 0), (800, [], 0), (-100, [-0.25] * 8, 0)]
PAGES = [(i, f"https://www.host{i % 3}.example/a/{i % 4}/?b=2&a=1&utm_source=x#top", f"<p>{i}</p>") for i in range(60)] + [
    (60, None, "x"), (61, "", None), (None, "http://host1.example/a", "y"), (5, "https://host2.example/a/1?a=1&b=2", "<p>5</p>"), (-3, "http://u@HOST0.example:80", "z"), (64, "m.host0.example?sid=4", "")]
TURNS = [(1, 0, "user", "\\\\### x </turn>"), (1, 1, "assistant", "####</turn></turn>\\"), (2, 0, None, None), (None, 0, "assistant", "x 🙂"), (3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (3, 1, "assistant", "a"), (4, 0, "assistant", None)]
NAMES = ["op1_secret_scans", "op2_chat_formatting", "op3_source_mixing", "op4_quality_rules", "op5_jaccard_join", "op6_suffix_dedup", "op9_exact_topk", "op10_warc_revisits", "op11_simhash_dedup", "op13_periodic_runs"]


@pytest.fixture(scope="module")
def odd_tables(spark, odd_docs, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("odd"))
    odd_docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(VECTORS, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    spark.createDataFrame(PAGES, "page_id bigint, url string, html string").write.parquet(f"{at}/pages.parquet")
    spark.createDataFrame(TURNS, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{at}/conversations.parquet")
    return at


@pytest.mark.parametrize("name", NAMES)
def test_query_and_sql(spark, odd_tables, name):
    import duckdb

    from pricewise.llm.queries import ORACLES, QUERIES
    assert sorted(ORACLES) == sorted(NAMES)
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{odd_tables}/{t}.parquet/*.parquet')")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, odd_tables)
    assert sorted(got.columns) == sorted(columns)
    got, want = Counter(tuple(r) for r in got.select(*columns).collect()), Counter(want.fetchall())
    assert ([*(got - want)][:2], [*(want - got)][:2]) == ([], [])
