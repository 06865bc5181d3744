r"""Secret scans (DataFrame functions only).

Base patterns: ``assign`` (a name such as password or api_key, a sign, and a value of 6 or more
characters), ``access`` (AKIA and 16 or more capitals or digits) and ``hex`` (24 or more lower-case hex
digits), each leftmost and non-overlapping within its kind; a match whose value is too short is
dropped after it has used up its place.

Added by the method: candidate strings (runs of 20 or more key characters) are scanned with a window
of 20 characters.  Sliding by one changes two counts, so the sum of c * log2(c), and with it the
Shannon entropy, is carried along.  The entropy needed depends on the candidate's character class.  A
span reaches from the first such window to the end of the last.  A candidate is cut at the base matches
and the allow-listed parts in it, and each rest of 20 or more characters is scanned as a candidate of its
own; only rests that are no secret as a whole (UUIDs, one character repeated) are left out.  Signs in front
of a candidate or beside a cut are scanned, but do not count for its class.  Base matches always stay.

Positions are code points: the texts between matches and the matches themselves are measured and
summed up.  Defined cases: null text = empty text = no spans; ties of start are ordered by kind;
repeated rows are scanned each; an empty table gives an empty result; ``scan`` hands all other columns
on, whatever their names, inside the struct ``d``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewise.llm.common import text_or_empty

KINDS = ("assign", "access", "hex", "entropy")


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


NAMES = "|".join(["password", "passwd", "secret", "token", "api_?key"])
ASSIGN = f"({either_case(NAMES)})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: Runs are taken whole, so a least length inside the pattern drops the same matches as a filter after it.
ACCESS, HEX = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"
LEAST_VALUE = 6
CANDIDATE = "(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
WINDOW = 20
#: Character class of a candidate (the first that fits) -> bits a character that a window needs.
CLASSES = (("^[0-9a-fA-F]*$", 2.9), ("^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])", 3.6), ("^(?=.*[A-Za-z])(?=.*[0-9])", 3.5), ("", 4.15))
#: Parts of candidates that are no secrets, cut out: examples, alphabets as far as they run, lines of signs.
ALLOWED = ("(?i)example", "(?i)placeholder", "(?i)0123456789|abcdefghij" + "".join(f"(?:{c}" for c in "klmnopqrstuvwxyz") + ")?" * 16, "[-=_]{4,}")
#: Candidates, or their rests, that are no secrets as a whole: UUIDs, one character repeated.
WHOLE = ("(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$", r"^(.)\1*$")
FRONT, BACK = "^[-=_+/]+", "[-=_+/]+$"


#: Elements of an array that a running value passes at a time, and code points of a stretch of text that lists its base matches.
RUN, STRETCH = 256, 4096


def let(value: Column, use) -> Column:
    """``use(value)``, with the value computed once, however often and in whatever lambda it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def before(values: Column, add, zero: Column) -> Column:
    """For each element, what ``add`` (associative) makes of ``zero`` and all elements before it; the last entry has all.

    In runs of RUN elements and then over the runs, so arrays that grow step by step stay short."""
    def grow(array: Column) -> Column:
        start = F.struct(zero.alias("now"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(array, start, lambda a, x: F.struct(add(a["now"], x).alias("now"), F.array_append(a["out"], a["now"]).alias("out")))

    def over(v: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / RUN).cast("int")), lambda k: grow(F.slice(v, k * RUN + 1, F.lit(RUN))))
        return let(runs, lambda r: let(grow(F.transform(r, lambda x: x["now"])), lambda o: F.array_append(
            F.flatten(F.zip_with(r, o["out"], lambda x, n: F.transform(x["out"], lambda w: add(n, w)))), o["now"])))

    return let(values, over)


def places(text: Column, pattern: str) -> Column:
    """Array of (start, end, s) of the leftmost non-overlapping matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)

    def placed(found: Column) -> Column:
        pairs = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda s, gap: F.struct(F.char_length(gap).alias("gap"), s.alias("s")))
        out = lambda p: F.zip_with(p, F.slice(before(F.transform(p, lambda x: x["gap"] + F.char_length(x["s"])), lambda a, x: a + x, F.lit(0)), F.lit(1), F.size(p)),
                                   lambda x, n: F.struct((n + x["gap"]).alias("start"), (n + x["gap"] + F.char_length(x["s"])).alias("end"), x["s"].alias("s")))
        return F.when(F.size(found) > 0, let(pairs, out)).otherwise(F.expr("cast(array() as array<struct<start:int,end:int,s:string>>)"))

    return let(found, placed)


def by_stretch(base: Column, chars: Column) -> Column:
    """For every STRETCH of a text the spans of ``base`` that touch it, so that a place need not look at all of them."""
    return F.transform(F.sequence(F.lit(0), F.floor(chars / STRETCH).cast("int")), lambda k: F.filter(base, lambda b: (b["start"] < (k + 1) * STRETCH) & (b["end"] > k * STRETCH)))


def rests(s: Column, stretches: Column, allowed: tuple[str, ...]) -> Column:
    """Array of (start, s, core) of what the base matches (``by_stretch``) and ``allowed`` leave of candidate ``s``; ``core`` is without the signs at its ends."""
    first, last = F.floor(s["start"] / STRETCH).cast("int"), F.floor(s["end"] / STRETCH).cast("int")
    near = F.flatten(F.slice(stretches, first + 1, last - first + 1))
    cuts = F.filter(near, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    cuts = F.transform(cuts, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end")))
    if allowed:
        known = places(s["s"], "|".join(f"(?:{p})" for p in allowed))
        cuts = F.concat(cuts, F.transform(known, lambda k: F.struct((s["start"] + k["start"]).alias("start"), (s["start"] + k["end"]).alias("end"))))
    # the end of the candidate as a last cut
    cuts = F.array_append(F.array_sort(cuts), F.struct(s["end"].alias("start"), s["end"].alias("end")))
    start = F.struct(s["start"].alias("pos"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("out"))

    def step(a: Column, c: Column) -> Column:
        rest = F.struct(a["pos"].alias("start"), c["start"].alias("end"))
        return F.struct(F.greatest(a["pos"], c["end"]).alias("pos"), F.when(c["start"] - a["pos"] >= WINDOW, F.array_append(a["out"], rest)).otherwise(a["out"]).alias("out"))

    def shape(r: Column) -> Column:
        text = F.substring(s["s"], r["start"] - s["start"] + 1, r["end"] - r["start"])
        core = F.regexp_replace(text, FRONT, "")
        return F.struct(r["start"].alias("start"), text.alias("s"), F.when(r["end"] < s["end"], F.regexp_replace(core, BACK, "")).otherwise(core).alias("core"))

    return F.filter(F.transform(F.aggregate(cuts, start, step, lambda a: a["out"]), shape), lambda r: ~_any(r["core"], WHOLE))


def busy_part(s: Column, core: Column | None = None) -> Column:
    """(first, last): starts of the first and the last window of ``s`` whose entropy reaches the class's (that of ``core``, if given); null if none does."""
    need, core = F.lit(CLASSES[-1][1]), s if core is None else core
    for pattern, bits in reversed(CLASSES[:-1]):
        need = F.when(core.rlike(pattern), F.lit(bits)).otherwise(need)
    weight = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 2)])
    f = lambda c: F.get(weight, c)
    codes = F.transform(F.split(s, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    zero = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
    steps = F.transform(codes, lambda c, i: F.struct(c.alias("new"), F.when(i >= WINDOW, F.get(codes, i - WINDOW)).otherwise(-1).alias("gone"), i.alias("i")))

    def step(a: Column, x: Column) -> Column:
        new, gone = x["new"], x["gone"]
        c_in, c_out = F.get(a["counts"], new), F.get(a["counts"], gone)
        total = F.when(new == gone, a["sum"]).otherwise(a["sum"] + f(c_in + 1) - f(c_in) + F.when(gone >= 0, f(c_out - 1) - f(c_out)).otherwise(0.0))
        counts = F.transform(a["counts"], lambda c, k: c + (k == new).cast("int") - (k == gone).cast("int"))
        hit = (x["i"] >= WINDOW - 1) & (F.lit(math.log2(WINDOW)) - total / WINDOW >= need)
        at = x["i"] - (WINDOW - 1)
        return F.struct(counts.alias("counts"), total.alias("sum"), F.when(hit & (a["first"] < 0), at).otherwise(a["first"]).alias("first"), F.when(hit, at).otherwise(a["last"]).alias("last"))

    return F.aggregate(steps, zero, step, lambda a: F.when(a["first"] >= 0, F.struct(a["first"].alias("first"), a["last"].alias("last"))))


def scan(docs: DataFrame, text: str = "text", allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """One column ``d`` with all columns of ``docs``, and ``spans``: array of (start, kind_no, end), in order."""
    x = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("d"))
    x = x.withColumn("t", text_or_empty(F.col(f"d.`{text}`")))
    x = x.withColumn("assign", places(F.col("t"), ASSIGN)).withColumn("access", places(F.col("t"), ACCESS)).withColumn("hex", places(F.col("t"), HEX)).withColumn("keys", places(F.col("t"), CANDIDATE))
    shape = lambda c, n: F.transform(c, lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("kind_no"), s["end"].alias("end")))
    long_enough = F.filter("assign", lambda s: F.char_length(F.regexp_extract(s["s"], ASSIGN, 2)) >= LEAST_VALUE)
    x = x.withColumn("base", F.concat(shape(long_enough, 0), shape(F.col("access"), 1), shape(F.col("hex"), 2)))
    left = let(by_stretch(F.col("base"), F.char_length("t")), lambda near: F.flatten(F.transform("keys", lambda s: rests(s, near, allowed))))
    parts = F.transform(left, lambda s: F.struct(s["start"].alias("start"), busy_part(s["s"], s["core"]).alias("p")))
    added = F.transform(F.filter(parts, lambda s: s["p"].isNotNull()), lambda s: F.struct((s["start"] + s["p"]["first"]).alias("start"), F.lit(3).alias("kind_no"), (s["start"] + s["p"]["last"] + WINDOW).alias("end")))
    return x.select("d", "t", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", F.when(F.size("keys") > 0, added).otherwise(F.expr("cast(array() as array<struct<start:int,kind_no:int,end:int>>)")))).alias("spans"))


def _any(s: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | s.rlike(p)
    return out


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind_no"]), s["start"], s["end"])), ",")


def span_digests(docs: DataFrame) -> DataFrame:
    x = scan(docs.select("doc_id", "text"))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind_no"] == k)).cast("long")
    return x.select("d.doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
                    F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by a mark, overlapping spans by one; ``n_chars``, where there is one, follows."""
    x = scan(docs, text)
    upto = before(F.transform("spans", lambda s: s["end"]), lambda a, e: F.greatest(a, e), F.lit(0))

    def marked(upto: Column) -> Column:
        parts = F.zip_with("spans", F.slice(upto, F.lit(1), F.size("spans")), lambda s, at: F.when(s["start"] < at, F.lit("")).otherwise(
            F.concat(F.substring(F.col("t"), at + 1, s["start"] - at), F.lit(mark))))
        return F.concat(F.array_join(parts, ""), F.substring(F.col("t"), F.element_at(upto, -1) + 1, F.char_length("t")))

    clean = let(upto, marked)
    x = x.withColumn("clean", F.when(F.size("spans") > 0, clean).otherwise(F.col(f"d.`{text}`")))
    out = []
    for c, kind in docs.dtypes:
        v = F.col(f"d.`{c}`")
        if c == text:
            v = F.col("clean")
        elif c == "n_chars":
            v = F.when(F.size("spans") > 0, F.char_length("clean").cast(kind)).otherwise(v)
        out.append(v.alias(c))
    return x.select(*out)
