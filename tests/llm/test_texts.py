"""Operators on single texts against plain Python over whole texts."""
import hashlib
import re
from collections import Counter

import pytest

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def differ(got, want):
    """A few rows that only one side has."""
    a, b = (Counter(tuple(sorted((k, repr(v)) for k, v in r.items())) for r in rows) for rows in (got, want))
    return [*(a - b)][:2], [*(b - a)][:2]


NONE = ([], [])


def test_secret_base_spans(odd_docs, odd_rows, no_docs):
    from pricewise.llm.secret_scan import span_digests
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    want = []
    for r in odd_rows:
        t = r["text"] or ""
        a = [m.span() for m in assign.finditer(t) if len(m[2]) >= 6]
        b = [m.span() for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        h = [m.span() for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        spans = sorted([(s, 0, e) for s, e in a] + [(s, 1, e) for s, e in b] + [(s, 2, e) for s, e in h])
        text = ",".join(f"{['assign', 'access', 'hex'][k]}:{s}:{e}" for s, k, e in spans)
        want.append({"doc_id": r["doc_id"], "n_assign": len(a), "n_access": len(b), "n_hex": len(h), "base_sha256": sha(text)})
    got = [r.asDict() for r in span_digests(odd_docs).collect()]
    spans = {r["doc_id"]: r.pop("spans") for r in got}
    assert differ(got, want) == NONE
    assert any(w["n_assign"] for w in want) and any(w["n_hex"] for w in want)
    assert "entropy:" in spans[900007]
    assert span_digests(no_docs).count() == 0


def test_secret_entropy_windows(spark):
    """The sliding sums give the entropy that counting each window anew gives."""
    import math
    import random

    from pricewise.llm import secret_scan as S
    rnd = random.Random(5)
    texts = ["".join(rnd.choices(S.ALPHABET[:rnd.choice([12, 30, 62])], k=rnd.randint(20, 60))) for _ in range(60)]
    rows = spark.createDataFrame([(t,) for t in texts], "s string")
    got = {r[0]: r[1] for r in rows.select("s", S.busy_part(rows.s)).collect()}
    for t in texts:
        need = next(b for p, b in S.CLASSES if re.search(p, t))
        ent = [-sum(c / 20 * math.log2(c / 20) for c in Counter(t[i:i + 20]).values()) for i in range(len(t) - 19)]
        if any(abs(e - need) < 1e-9 for e in ent):
            continue
        hits = [i for i, e in enumerate(ent) if e >= need]
        assert (got[t] and tuple(got[t])) == ((hits[0], hits[-1]) if hits else None)


def test_secret_allow_list_and_redaction(spark):
    from pricewise.llm.secret_scan import redact, span_digests
    d = spark.createDataFrame([(1, "uuid 123e4567-e89b-12d3-a456-426614174000 EXAMPLEzx9Qm2Lp8Rt4Wv6Ys1", 7), (2, "é token = abcdefgh1 x", 9), (3, "plain", 5)], "doc_id bigint, text string, n_chars int")
    assert span_digests(d).where("doc_id = 1").first()["spans"] == ""
    out = {r["doc_id"]: r for r in redact(d).collect()}
    assert out[2]["text"] == "é [SECRET] x" and out[2]["n_chars"] == 12 and out[3]["text"] == "plain" and out[3]["n_chars"] == 5


KEY = "Zx9Qm2Lp8Rt4Wv6Ys1Bn3Kd7Hf5Jg0Tc9Uv2Ew6Xa"


def test_secret_beside_base_match_or_allowed_part(spark):
    """A base match or an allow-listed part does not hide the key that it is joined to."""
    from pricewise.llm.secret_scan import redact, span_digests
    access, digits = "AKIA" + "Q7WERTYUIOPASDFG", "0f1e2d3c4b5a69788796a5b4"
    upper = "9F86D081884C7D659A2FEAA0C55AD015"
    texts = [f"é {access}/{KEY} x", f"{KEY}_token=abcdef x", *[f"{digits}{j}{KEY} x" for j in "_-/="], *[f"{KEY}{j}{digits} x" for j in "_-/="],
             *[f"see {j}{KEY} x" for j in "-=_+/"], f"example-{KEY}", f"{KEY}----{KEY}", f"0123456789{KEY}", f"{KEY}abcdefghijklmnop placeholder", f"+{upper}", f"{upper}_token=abcdef"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    out = {r["doc_id"]: r["text"] for r in redact(d).collect()}
    for i, t in enumerate(texts):
        assert KEY not in out[i] and upper not in out[i], t
        assert KEY[12:32] not in out[i], t
    spans = {r["doc_id"]: r["spans"] for r in span_digests(d).collect()}
    assert spans[0].startswith("access:2:22,entropy:22:") and "assign:" in spans[1] and "entropy:0:" in spans[1]
    quiet = ["/123e4567-e89b-12d3-a456-426614174000", "==========================", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
             "abcdefghijklmnopqrstuvwxyz1234567890", "EXAMPLE-" + KEY[:18], "/" + "Q" * 30, "--------------------------------x"]
    q = spark.createDataFrame(list(enumerate(quiet)), "doc_id bigint, text string")
    assert [r["spans"] for r in span_digests(q).orderBy("doc_id").collect()] == [""] * len(quiet)


def plain_measures(t):
    t = t or ""
    w = SPACE.findall(t)
    tri = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if tri[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if SPACE.search(line):
            dup += line in seen
            seen.add(line)
    n, rep = len(w), len(covered)
    return {"n_words": n, "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t), "n_dup_lines": dup, "n_repeat_words": rep, "base_failed": n < 50 or 100 * rep > 50 * n}


def test_quality_measures(odd_docs, odd_rows, no_docs):
    from pricewise.llm.quality import filter_documents, verdicts
    got = [r.asDict() for r in verdicts(odd_docs).collect()]
    kept = [r.pop("kept") for r in got]
    assert differ(got, [{"doc_id": r["doc_id"], **plain_measures(r["text"])} for r in odd_rows]) == NONE
    assert not any(k and r["base_failed"] for k, r in zip(kept, got)) and sum(kept) > 0.5 * len(kept)
    stay = filter_documents(odd_docs)
    assert stay.columns == odd_docs.columns and stay.count() == sum(kept)
    assert verdicts(no_docs).count() == 0 and filter_documents(no_docs).count() == 0


def test_quality_thresholds(odd_docs, odd_rows):
    """Quantiles of bucketed ratios per group, computed plainly."""
    import math

    from pricewise.llm import quality as Q
    m = Q.measure(odd_docs.select("doc_id", "lang", "source", "text")).select("lang", "source", "m").cache()
    got = {(r["lang"], r["source"]): r["limits"] for r in Q.thresholds(m).collect()}
    groups = {}
    for r in m.select("lang", "source", *[v.alias(k) for k, v in Q.ratios().items()]).collect():
        for k in Q.SLACK:
            v = int(r[k])
            groups.setdefault((r["lang"], r["source"]), {}).setdefault(k, []).append(v - v % 2 ** max(0, v.bit_length() - 5))
    q = lambda vs, p: sorted(vs)[max(0, math.ceil(p * len(vs)) - 1)]
    want = {g: {k: min(q(vs, 0.5) + max(Q.SLACK[k], Q.REACH * (q(vs, Q.UPPER) - q(vs, 0.5))), Q.CEILING[k]) for k, vs in x.items()} for g, x in groups.items()}
    assert {g: (got[g], want[g]) for g in want if got[g] != want[g]} == {} and len(got) == len(want)
    m.unpersist()


def test_pieces_round_trip(odd_docs, odd_rows, no_docs):
    import public_tokenizers as P
    import sentencepiece

    from pricewise.llm.pieces import encode_decode, token_digests
    path = P.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    want = []
    for r in odd_rows:
        ids = lib.encode(r["text"] or "")
        want.append({"doc_id": r["doc_id"], "n_tokens": len(ids), "ids_sha256": sha(",".join(map(str, ids))), "decoded_sha256": sha(lib.decode(ids) if ids else "")})
    assert differ([r.asDict() for r in token_digests(odd_docs, path).collect()], want) == NONE
    assert token_digests(no_docs, path).count() == 0
    assert encode_decode(odd_docs, path).columns == [*odd_docs.columns, "ids", "decoded"]


def test_pieces_agenda_forms_agree():
    import random

    import public_tokenizers as P

    from pricewise.llm.pieces import Pieces
    p, rnd = Pieces(P.path("piece_bpe_32k.model")), random.Random(3)
    texts = ["".join(rnd.choices("abetinso ▁éЖ\n\t.🙂", k=rnd.randint(0, 39))) for _ in range(3000)]
    parts = [s.replace(" ", "▁") for s in texts if s]
    import numpy as np
    for part, ids in zip(parts, p.agendas(parts)):
        assert np.frombuffer(ids, np.int32).tolist() == p.agenda(part)
    for s in texts:
        ids = np.frombuffer(p.encode([s])[0], np.int32).tolist()
        assert ids == p.library.encode(s) and p.decode([ids, []]) == [p.library.decode(ids), ""]


def test_pieces_check_finds_a_difference():
    import public_tokenizers as P

    from pricewise.llm.pieces import Pieces
    p = Pieces(P.path("piece_bpe_32k.model"))
    for part in ("▁word", "word", "▁▁", "\n"):
        good = p.learn({"other", part})
        with pytest.raises(AssertionError):
            p.check({**good, part: good[part] + good[part]})


def test_token_histogram(odd_docs, odd_rows, no_docs, monkeypatch):
    import public_tokenizers as P

    from pricewise.llm import lengths as L
    monkeypatch.setattr(L, "BLOCK", 64)
    path = P.path("byte_bpe_50k.tiktoken")
    enc = L._encoder(path, P.PATTERN)
    n = [len(enc.encode_ordinary(r["text"] or "")) for r in odd_rows]
    got = {r["n_tokens"]: r for r in L.length_histogram(L.encoded_lengths(odd_docs, path, P.PATTERN)).collect()}
    assert set(got) == set(n)
    for k, r in got.items():
        assert (r["n_docs"], r["docs_within"], r["docs_longer"]) == (n.count(k), sum(x <= k for x in n), sum(x > k for x in n))
        assert (r["tokens_within"], r["truncated_total"], r["total_tokens"]) == (sum(x for x in n if x <= k), sum(min(x, k) for x in n), sum(n))
        assert r["quantile"] == pytest.approx(r["docs_within"] / len(n))
    assert L.length_histogram(L.encoded_lengths(no_docs, path, P.PATTERN)).count() == 0


def test_chat(spark):
    import public_tokenizers as P

    from pricewise.llm.chat import conversation_digests, escaped, format_turns, unescaped
    tricky = ["\\### Assistant: </turn> ok", "####", "\\\\</turn>", "</turn></turn>###", "\\", "a\\###\\\\\\###", ""]
    for t in tricky:
        assert unescaped(escaped(t)) == t
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(tricky)] + [(2, 0, None, None), (None, 0, "user", "x"), (3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (3, 1, "assistant", "a")]
    c = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(4)
    path = P.path("byte_bpe_50k.tiktoken")
    got = {r["conv_id"]: r for r in conversation_digests(c, path, P.PATTERN).collect()}
    convs = {}
    for cid, turn, role, text in rows:
        convs.setdefault(cid, []).append((turn, role or "", text or ""))
    for cid, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        g = got[cid]
        assert (g["n_turns"], g["loss_chars"], g["loss_sha256"]) == (len(turns), len(loss), sha(loss))
        assert g["turns_sha256"] == sha("".join(f"{r}\n{t}\n" for _, r, t in turns))
        assert g["formatted_chars"] == sum(len(f"### {r.capitalize()}: {escaped(t)} </turn>\n") for _, r, t in turns)
    reserved = max(i for r in format_turns(c, path, P.PATTERN).collect() for i in r["ids"])
    assert reserved >= 50256
    assert conversation_digests(c.where("false"), path, P.PATTERN).count() == 0
