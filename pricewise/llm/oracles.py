"""DuckDB SQL for the queries of this package that SQL can express.

Each text states the result from its definition and not by the operator's method: all pairs that share a
shingle in place of prefixes, all windows grouped by digest in place of digit passes, every inner
product in place of trees.  So the agreement of both means something; none of it is meant for large
tables.  Token counts and pieces need the tokenizers' libraries and have none.
"""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"
_BLANK = r"[\x20\x09-\x0D]"

_FOUND = r"""
    SELECT rid, {no} AS kind_no, s, gaps + before AS start FROM (
        SELECT rid, i, ms[i] AS s,
               list_sum(list_transform(gs[1:i], lambda g: length(g))) AS gaps,
               coalesce(list_sum(list_transform(ms[1:i - 1], lambda m: length(m))), 0) AS before
        FROM (SELECT rid, regexp_extract_all(t, '{pattern}', 0) AS ms, string_split_regex(t, '{pattern}') AS gs FROM d), generate_series(1, len(ms)) AS n(i))"""


def _secrets() -> str:
    from pricewise.llm.secret_scan import ACCESS, ALLOWED, ASSIGN, HEX, WINDOW

    assign = ASSIGN.replace("'", "''")
    found = [_FOUND.format(no=n, pattern=p) for n, p in enumerate((assign, ACCESS, HEX, "[A-Za-z0-9+/=_-]{20,}"))]
    allowed = "|".join(f"(?:{p})" for p in ALLOWED)
    known = _FOUND.replace("FROM d)", "FROM (SELECT cid AS rid, s AS t FROM candidate))").format(no=4, pattern=allowed)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(found)}),
base AS (SELECT rid, kind_no, start::BIGINT AS start, (start + length(s))::BIGINT AS fin FROM found
         WHERE kind_no < 3 AND (kind_no > 0 OR length(regexp_extract(s, '{assign}', 2)) >= 6)),
candidate AS (SELECT row_number() OVER () AS cid, rid, s, start::BIGINT AS start, (start + length(s))::BIGINT AS fin FROM found WHERE kind_no = 3),
known AS ({known}),
cut AS (SELECT cid, b.start AS a, b.fin AS z FROM candidate c JOIN base b ON b.rid = c.rid AND b.start < c.fin AND c.start < b.fin
        UNION ALL SELECT cid, (c.start + k.start)::BIGINT, (c.start + k.start + length(k.s))::BIGINT FROM candidate c JOIN known k ON k.rid = c.cid
        UNION ALL SELECT cid, fin, fin FROM candidate),
gap AS (SELECT cid, a, z, max(z) OVER (PARTITION BY cid ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM cut),
piece AS (SELECT cid, rid, greatest(coalesce(upto, start), start) AS start, a AS fin, substr(s, greatest(coalesce(upto, start), start) - start + 1, a - greatest(coalesce(upto, start), start)) AS s, a < c.fin AS inner_
          FROM gap JOIN candidate c USING (cid) WHERE a - greatest(coalesce(upto, start), start) >= {WINDOW}),
core AS (SELECT *, row_number() OVER () AS pid, regexp_replace(CASE WHEN inner_ THEN regexp_replace(s, '[-=_+/]+$', '') ELSE s END, '^[-=_+/]+', '') AS k FROM piece),
need AS (
    SELECT *, CASE WHEN regexp_matches(k, '^[0-9a-fA-F]*$') THEN 2.9::DOUBLE
                   WHEN regexp_matches(k, '[a-z]') AND regexp_matches(k, '[A-Z]') AND regexp_matches(k, '[0-9]') THEN 3.6::DOUBLE
                   WHEN regexp_matches(k, '[A-Za-z]') AND regexp_matches(k, '[0-9]') THEN 3.5::DOUBLE ELSE 4.15::DOUBLE END AS bits FROM core
    WHERE NOT regexp_matches(k, '(?i)^[0-9a-f]{{8}}(-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}$') AND NOT (k <> '' AND replace(k, k[1], '') = '')),
letter AS (SELECT pid, pos, substr(s, pos + o, 1) AS c FROM need, generate_series(1, length(s) - {WINDOW - 1}) AS a(pos), generate_series(0, {WINDOW - 1}) AS o(o)),
entropy AS (SELECT pid, pos, -sum(n / {WINDOW}.0::DOUBLE * log2(n / {WINDOW}.0::DOUBLE)) AS h FROM (SELECT pid, pos, c, count(*)::DOUBLE AS n FROM letter GROUP BY ALL) GROUP BY ALL),
added AS (SELECT rid, 3 AS kind_no, start + min(pos) - 1 AS start, start + max(pos) - 1 + {WINDOW} AS fin FROM need JOIN entropy USING (pid) WHERE h >= bits GROUP BY pid, rid, start),
spans AS (SELECT rid, kind_no, start, ['assign', 'access', 'hex', 'entropy'][kind_no + 1] || ':' || start::BIGINT || ':' || fin::BIGINT AS said
          FROM (SELECT * FROM base UNION ALL SELECT * FROM added))
SELECT doc_id, count(*) FILTER (kind_no = 0) AS n_assign, count(*) FILTER (kind_no = 1) AS n_access, count(*) FILTER (kind_no = 2) AS n_hex,
       sha256(coalesce(string_agg(said, ',' ORDER BY start, kind_no) FILTER (kind_no < 3), '')) AS base_sha256,
       coalesce(string_agg(said, ',' ORDER BY start, kind_no), '') AS spans
FROM d LEFT JOIN spans USING (rid) GROUP BY rid, doc_id"""


CHAT = r"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('### : ' || role || ' </turn>' || chr(10)) + length(regexp_replace(text, '(\\*)(###|</turn>)', '\1\1\\\2', 'g')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""

MIXING = r"""
WITH size AS (SELECT source, sum(length(coalesce(text, '')))::DOUBLE AS size FROM documents GROUP BY source),
total AS (SELECT sum(size) AS s, sum(pow(size, 0.7)) FILTER (size > 0) AS w FROM size),
rate AS (SELECT source, CASE WHEN s = 0 THEN 1 WHEN size = 0 THEN 0 ELSE pow(size, 0.7) / w * s / size END AS rate FROM size, total),
mean AS (SELECT *, greatest(1, ceil(rate / 16))::BIGINT AS pieces, rate / greatest(1, ceil(rate / 16)) AS m FROM rate),
term AS (SELECT source, pieces, k, CASE WHEN m = 0 THEN (k = 0)::INTEGER::DOUBLE ELSE exp(k * ln(m) - m - lgamma(k + 1)) END AS p FROM mean, generate_series(0, 79) AS g(k)),
cdf AS (SELECT source, pieces, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS upto FROM term),
d AS (SELECT row_number() OVER () AS rid, * FROM documents),
draw AS (SELECT rid, d.source, (('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null') || ':' || j), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496 AS u
         FROM d JOIN mean ON d.source IS NOT DISTINCT FROM mean.source, generate_series(1, pieces) AS g(j)),
n AS (SELECT rid, count(*) AS n FROM draw JOIN cdf ON draw.source IS NOT DISTINCT FROM cdf.source AND upto < u GROUP BY rid)
SELECT d.* EXCLUDE (rid), copy::INTEGER AS mix_copy, md5('17 order:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy) AS mix_key
FROM d JOIN n USING (rid), generate_series(0, n - 1) AS g(copy)"""

QUALITY = rf"""
WITH d AS (
    SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents),
word AS (SELECT rid, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM d),
three AS (SELECT rid, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM word WINDOW o AS (PARTITION BY rid ORDER BY i)),
win AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM three WHERE c IS NOT NULL),
again AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM win, generate_series(0, 2) AS g(k) WHERE n >= 2 GROUP BY rid),
m AS (SELECT rid, doc_id, lang, source, len(w) AS n_words, length(regexp_replace(t, '{_BLANK}', '', 'g')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines FROM d LEFT JOIN again USING (rid)),
r AS (SELECT rid, lang, source, 'symbols' AS k, 100 AS slack, 1000 AS most, n_symbols * 1000 // greatest(n_words, 1) AS v FROM m
      UNION ALL SELECT rid, lang, source, 'dup_lines', 400, 700, n_dup_lines * 1000 // greatest(n_lines, 1) FROM m
      UNION ALL SELECT rid, lang, source, 'repeats', 200, 500, n_repeat_words * 1000 // greatest(n_words, 1) FROM m
      UNION ALL SELECT rid, lang, source, 'word_len', 3000, 20000, word_chars * 1000 // greatest(n_words, 1) FROM m),
b AS (SELECT *, v - v % pow(2, greatest(0, length(bin(v)) - 5))::BIGINT AS b FROM r),
q AS (SELECT lang, source, k, slack, most, quantile_disc(b, 0.5) AS mid, quantile_disc(b, 0.75) AS high FROM b GROUP BY ALL),
bad AS (SELECT DISTINCT rid FROM r JOIN q ON r.lang IS NOT DISTINCT FROM q.lang AND r.source IS NOT DISTINCT FROM q.source AND r.k = q.k
        WHERE v > least(mid + greatest(q.slack, 4 * (high - mid)), q.most))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND bad.rid IS NULL AS kept
FROM m LEFT JOIN bad USING (rid)"""

JACCARD = rf"""
WITH RECURSIVE d AS (
    SELECT row_number() OVER () AS rid, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
sh AS (SELECT DISTINCT rid, array_to_string(w[i:i + 3], ' ') AS s FROM d, generate_series(1, greatest(len(w) - 3, 1)) AS g(i) WHERE len(w) > 0),
size AS (SELECT rid, count(*) AS n FROM sh GROUP BY rid),
sized AS (SELECT rid, s, n FROM sh JOIN size USING (rid)),
link AS (SELECT a.rid AS x, b.rid AS y FROM sized a JOIN sized b ON a.s = b.s AND a.rid < b.rid AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
         GROUP BY a.rid, b.rid, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT rid AS x, rid AS y FROM d UNION SELECT r.x, l.y FROM reach r JOIN both_ways l ON r.y = l.x)
SELECT d.doc_id, coalesce(size.n, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN size USING (rid) JOIN (SELECT r.x AS rid, min(e.doc_id) AS component_id FROM reach r JOIN d e ON e.rid = r.y GROUP BY r.x) c USING (rid)"""

#: Bytes as pairs of hex digits; windows are cut from pieces of 799 bytes, each of which holds the starts of 400.
SUFFIXES = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
piece AS (SELECT rid, 400 * j AS pos, substr(h, 800 * j + 1, 1598) AS p FROM d, generate_series(0, length(h) // 800) AS g(j)),
win AS (SELECT rid, pos + i AS pos, md5(substr(p, 2 * i + 1, 800)) AS m FROM piece, generate_series(0, least(399, length(p) // 2 - 400)) AS g(i)),
twice AS (SELECT rid, pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY m) AS n FROM win) WHERE n > 1),
cut AS (SELECT rid, pos, coalesce(pos > lag(pos) OVER (PARTITION BY rid ORDER BY pos) + 400, TRUE) AS opens FROM twice),
numbered AS (SELECT rid, pos, sum(opens::INT) OVER (PARTITION BY rid ORDER BY pos) AS run FROM cut),
runs AS (SELECT rid, min(pos) AS a, max(pos) + 400 AS b FROM numbered GROUP BY rid, run),
edge AS (SELECT rid, a, b FROM runs UNION ALL SELECT rid, length(h) // 2, length(h) // 2 FROM d),
gap AS (SELECT rid, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a, b), 0) AS x, a AS y, b - a AS n FROM edge)
SELECT doc_id, any_value(length(h)) // 2 AS n_bytes, sum(n)::BIGINT AS n_removed, count(*) FILTER (n > 0) AS n_spans,
       sha256(unhex(string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x, y))) AS kept_sha256
FROM d JOIN gap USING (rid) GROUP BY rid, doc_id"""

TOPK = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id, min(v) AS v FROM v WHERE vec_id % 100 = 0 GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.v, v.v)::BIGINT AS score FROM q JOIN v ON q.vec_id <> v.vec_id AND len(q.v) = len(v.v))
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""

REVISITS = r"""
WITH a AS (SELECT page_id, md5(coalesce(html, '')) AS digest, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM pages),
b AS (SELECT page_id, digest,
             regexp_replace(regexp_replace(lower(regexp_extract(rest, '^(?:[^/?@]*@)?([^/?]*)', 1)), ':(80|443)$', ''), '^(www\d*|m)\.', '') AS host,
             regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
             list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'),
                 lambda p: p <> '' AND NOT regexp_matches(p, '(?i)^(ref|utm_[a-z]+|sessionid|sid|phpsessionid|fbclid|gclid)(=|$)'))) AS query FROM a),
r AS (SELECT page_id * 10 + visit AS record_id, visit,
             host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END AS key,
             1700000000 + ((page_id * 7919) % 2592000 + 2592000) % 2592000 + visit * (172800 + (page_id % 97 + 97) % 97 * 3600) AS s,
             '"' || substr(digest, 1, 12) || CASE WHEN visit = 2 AND page_id % 5 = 0 THEN '-new' ELSE '' END || '"' AS etag
      FROM b, generate_series(0, 2) AS g(visit)),
whole AS (SELECT key, s, max_by(etag, record_id) AS etag, max(record_id) AS record_id FROM r WHERE visit = 0 AND key IS NOT NULL AND s IS NOT NULL GROUP BY key, s),
x AS (SELECT r.record_id, r.key, r.s, r.visit, r.etag, w.record_id AS found, w.etag AS theirs FROM r ASOF LEFT JOIN whole w ON r.key = w.key AND r.s >= w.s WHERE r.visit > 0)
SELECT record_id, key AS canonical_url, s AS at_s, CASE WHEN etag = theirs THEN found END AS resolved_id,
       CASE WHEN key IS NULL THEN 'no_url' WHEN s IS NULL THEN 'no_time' WHEN found IS NULL THEN 'no_earlier' WHEN etag = theirs THEN 'resolved' ELSE 'changed' END AS outcome,
       CASE WHEN etag = theirs THEN 'cache-control: max-age=' || visit * 60 || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || s || chr(10)
                                    || 'etag: ' || etag || chr(10) || 'server: s0' END AS headers
FROM x"""

#: CRC-32 of the id's digits by its definition, bit by bit; then every pair of equal words, whose unbroken rows at one distance are the
#: stretches with that period, of which those of a multiple of a smaller period fall out.
PERIODS = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
                  CASE WHEN doc_id IS NOT NULL THEN list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)) END AS digits FROM documents),
c AS (SELECT rid, doc_id, w, len(w) AS n, xor(list_reduce(digits, lambda crc, b: list_reduce([xor(crc, b), 1, 2, 3, 4, 5, 6, 7, 8],
                 lambda x, _: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295::BIGINT) AS h FROM d),
g AS (SELECT *, h // 10 AS g FROM c),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM g),
t AS (SELECT rid, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) END AS w FROM a),
word AS (SELECT rid, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM t),
pair AS (SELECT u.rid, u.i, v.i - u.i AS p FROM word u JOIN word v ON u.rid = v.rid AND u.x = v.x AND u.i < v.i),
isle AS (SELECT rid, p, i, i - row_number() OVER (PARTITION BY rid, p ORDER BY i) AS k FROM pair),
run AS (SELECT rid, p, min(i) AS s, max(i) + p + 1 AS e FROM isle GROUP BY rid, p, k HAVING count(*) + p >= greatest(12, 2 * p)),
best AS (SELECT * FROM run r WHERE NOT EXISTS (SELECT 1 FROM run q WHERE q.rid = r.rid AND q.p < r.p AND r.p % q.p = 0 AND q.s <= r.s AND q.e >= r.e)),
per AS (SELECT rid, count(*) AS n_runs, arg_min(struct_pack(s := s, l := e - s, p := p), (s - e, s, p)) AS m,
               string_agg(s || ',' || (e - s) || ',' || p || chr(10), '' ORDER BY s, p) AS said FROM best GROUP BY rid),
gone AS (SELECT DISTINCT rid, unnest(range(s + p, e)) AS i FROM best),
kept AS (SELECT word.rid, string_agg(x, ' ' ORDER BY word.i) AS said FROM word ANTI JOIN gone ON word.rid = gone.rid AND word.i = gone.i GROUP BY word.rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, m.s AS start, m.l AS length, m.p AS period, 1000 * m.l // m.p AS exponent_milli,
       sha256(coalesce(per.said, '')) AS runs_sha256, sha256(coalesce(kept.said, '')) AS collapsed_sha256
FROM t LEFT JOIN per USING (rid) LEFT JOIN kept USING (rid)"""



def _simhash() -> str:
    """XXH64 from its definition, in 128-bit integers modulo 2**64, over distinct shingles; then bits and all pairs."""
    p1, p2, p3, p4, p5 = (f"{v}::UHUGEINT" for v in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
    whole = "18446744073709551616::UHUGEINT"
    add = lambda *x: "((" + " + ".join(x) + f") % {whole})"
    mul = lambda a, b: f"(({a} * {b}) % {whole})"
    rot = lambda a, r: f"((({a} * {1 << r}::UHUGEINT) % {whole}) + {a} // {1 << (64 - r)}::UHUGEINT)"
    let = lambda value, use: f"list_transform([{value}], lambda v: {use})[1]"
    fold = lambda start, items, step: f"list_reduce(list_prepend({start}, {items}), lambda h, x: {step})"
    turn = lambda acc, lane: mul(let(add(acc, mul(lane, p2)), rot("v", 31)), p1)
    seeds = (add("42::UHUGEINT", p1, p2), add("42::UHUGEINT", p2), "42::UHUGEINT", add("42::UHUGEINT", whole, f"({whole} - {p1})"))
    lanes = ", ".join(f"{fold(z, f'list_filter(lanes[1:stripes * 4], lambda x, i: i % 4 = {(k + 1) % 4})', turn('h', 'x'))} AS v{k}" for k, z in enumerate(seeds))
    merged = add(*(rot(f"v{k}", r) for k, r in enumerate((1, 7, 12, 18))))
    for k in range(4):
        merged = add(mul(f"xor({merged}, {turn('0::UHUGEINT', f'v{k}')})", p1), p4)
    eight = add(mul(let(f"xor(h, {turn('0::UHUGEINT', 'x')})", rot("v", 27)), p1), p4)
    four = add(mul(let(f"xor(h, {mul('x', p1)})", rot("v", 23)), p2), p3)
    one = mul(let(f"xor(h, {mul('x', p5)})", rot("v", 11)), p1)
    last = mul(let(mul(let("h", "xor(v, v // 8589934592::UHUGEINT)"), p2), "xor(v, v // 536870912::UHUGEINT)"), p3)
    little = lambda n, at: "('0x' || " + " || ".join(f"substr(x, 2 * ({at} + {k}) + 1, 2)" for k in reversed(range(n))) + ")::UBIGINT::UHUGEINT"
    return rf"""
WITH RECURSIVE d AS (
    SELECT row_number() OVER () AS rid, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
sh AS (SELECT rid, array_to_string(w[i:i + 3], ' ') AS s FROM d, generate_series(1, greatest(len(w) - 3, 1)) AS g(i) WHERE len(w) > 0),
b AS (SELECT s, hex(encode(s)) AS x, length(hex(encode(s))) // 2 AS n FROM (SELECT DISTINCT s FROM sh)),
l AS (SELECT s, x, n, n // 32 AS stripes, list_transform(range(n // 8), lambda i: {little(8, "8 * i")}) AS lanes FROM b),
v AS (SELECT *, {lanes} FROM l),
h0 AS (SELECT *, {add(f"CASE WHEN n >= 32 THEN {merged} ELSE {add('42::UHUGEINT', p5)} END", "n::UHUGEINT")} AS h FROM v),
h1 AS (SELECT s, x, n, {fold("h", "lanes[stripes * 4 + 1:]", eight)} AS h FROM h0),
h2 AS (SELECT s, x, n, n - n % 4 AS m, CASE WHEN n % 8 >= 4 THEN list_transform([{little(4, "(n - n % 8)")}], lambda x: {four})[1] ELSE h END AS h FROM h1),
h3 AS (SELECT s, {fold("h", "list_transform(range(m, n), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::UBIGINT::UHUGEINT)", one)} AS h FROM h2),
h4 AS (SELECT s, {let(last, "xor(v, v // 4294967296::UHUGEINT)")}::UBIGINT AS h FROM h3),
bits AS (SELECT rid, k, count(*) FILTER (h // (1::UBIGINT << k) % 2 = 1) AS n, count(*) AS of FROM sh JOIN h4 USING (s), generate_series(0, 63) AS g(k) GROUP BY rid, k),
fp AS (SELECT d.rid, doc_id, coalesce(bit_or(1::UBIGINT << k) FILTER (2 * n > of), 0::UBIGINT) AS fp FROM d LEFT JOIN bits USING (rid) GROUP BY d.rid, doc_id),
one AS (SELECT fp, min(doc_id) AS least FROM fp GROUP BY fp),
link AS (SELECT a.fp AS x, b.fp AS y FROM one a JOIN one b ON a.fp <> b.fp AND bit_count(xor(a.fp, b.fp)::UHUGEINT::HUGEINT) <= 4),
reach AS (SELECT fp AS x, fp AS y FROM one UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x)
SELECT doc_id, lpad(lower(to_hex(fp.fp)), 16, '0') AS fingerprint, c.component_id
FROM fp JOIN (SELECT r.x, min(o.least) AS component_id FROM reach r JOIN one o ON o.fp = r.y GROUP BY r.x) c ON c.x = fp.fp"""


ORACLES: dict[str, str] = {
    "op1_secret_scans": _secrets(), "op2_chat_formatting": CHAT, "op3_source_mixing": MIXING, "op4_quality_rules": QUALITY, "op5_jaccard_join": JACCARD,
    "op6_suffix_dedup": SUFFIXES, "op9_exact_topk": TOPK, "op10_warc_revisits": REVISITS,
    "op11_simhash_dedup": _simhash(), "op13_periodic_runs": PERIODS}
