"""SentencePiece encoding and decoding of merge-type vocabularies.

Method: a score-ordered agenda of adjacent symbol pairs.  A text is cut where no piece of the
vocabulary can reach across (before a space mark that follows another character, and around
characters that occur in no piece), each cut part starts as single characters, and its agenda gives the
best-scored adjacent pair, leftmost first among equals, until no pair is a piece.  Symbols are numbers and
a hash table holds the pairs that merge; short parts have their agendas side by side, long ones a heap.
Characters left over become byte pieces.  Parts repeat, so a worker remembers their ids; every part is
checked against the ``sentencepiece`` library when it is new, all of an Arrow batch in one call.  Ids are
decoded by the library.

Defined cases: null text = empty text = no ids and an empty decoded text; ties go to the leftmost
pair; repeated rows are encoded each for itself; an empty table gives an empty table; other columns
pass through unless named like the two outputs, which replace them.
"""

from __future__ import annotations

import re
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewise.llm.common import python_ready

MARK = "▁"
#: Parts that a worker remembers, and the longest part that it remembers.
REMEMBERED, LONGEST = 250_000, 64
#: A part of up to so many symbols has its agenda beside those of other parts, a longer one in a heap of its own.
SHORT = 40
#: Parts handled side by side, and how much their lengths may differ.
ROWS, STEP = 1 << 15, 4
NEVER_RANK = np.int32(2 ** 31 - 1)


class Memory(dict):
    """Part -> ids as bytes; parts not seen lately fall out, a generation at a time."""

    def __init__(self):
        super().__init__()
        self.old: dict = {}

    def turn(self) -> None:
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()

    def __missing__(self, part):
        v = self.old[part]
        self[part] = v
        return v


class Pieces:
    def __init__(self, model_path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        model = pb.ModelProto()
        with open(model_path, "rb") as f:
            model.ParseFromString(f.read())
        spec, kind = model.normalizer_spec, pb.ModelProto.SentencePiece
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("a merge-type vocabulary without text normalisation is needed")
        if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.dummy = spec.add_dummy_prefix
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == kind.UNKNOWN)
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        self.scores = {p.piece: -p.score for p in model.pieces if p.type == kind.NORMAL}
        self.bytes = [0] * 256
        for i, p in enumerate(model.pieces):
            if p.type == kind.BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
        self.size = len(model.pieces)
        self.fallback = model.trainer_spec.byte_fallback
        inside = {c for p in self.ids for c in p}
        alone = "".join(c for c in "\n\t\r" if c not in inside)
        crossing = any(MARK in p.lstrip(MARK) for p in self.ids)
        self.parts = None if crossing or not alone else re.compile(f"[{alone}]|{MARK}*[^{MARK}{alone}]+|{MARK}+").findall
        #: A character that no piece holds, with its ids: parts behind it are encoded for themselves.
        self.apart = alone[:1] if self.parts else ""
        self.apart_ids = self.numbered([self.apart]) if self.apart else []
        self.pairs()
        self.memory = Memory()

    def pairs(self) -> None:
        """Numbers of symbols (pieces, then the characters that only occur inside pieces) and the hash table of pairs that
        merge: the numbers of both -> rank of the score (equal scores, equal rank) and number of the piece."""
        number = dict(self.ids)
        for c in sorted({c for p in self.ids for c in p} - number.keys()):
            number[c] = self.size + len(number) - len(self.ids)
        self.symbols = self.size + len(number) - len(self.ids)
        self.of_char = np.full(0x110000, -1, np.int32)
        rank = {v: i for i, v in enumerate(sorted(set(self.scores.values())))}
        for c, i in number.items():
            if len(c) == 1:
                self.of_char[ord(c)] = i
        rows = [(number[p[:k]] * self.symbols + number[p[k:]], rank[self.scores[p]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
        self.bits = max(4, (4 * len(rows)).bit_length())
        self.keys, self.ranks, self.made = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NEVER_RANK, np.int32), np.full(1 << self.bits, -1, np.int32)
        slot = self.slot(np.array([r[0] for r in rows], np.int64)).tolist() if rows else []
        taken = set()
        for s, (key, r, i) in zip(slot, rows):
            while s in taken:
                s = s + 1 & (1 << self.bits) - 1
            taken.add(s)
            self.keys[s], self.ranks[s], self.made[s] = key, r, i

    def slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def found(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slots of pairs of symbols; the slot of a pair that does not merge is a free one (rank NEVER_RANK)."""
        key = left.astype(np.int64) * self.symbols + right
        key[(left < 0) | (right < 0)] = -2
        at = self.slot(key)
        open_ = np.flatnonzero((self.keys[at] != key) & (self.keys[at] != -1))
        while len(open_):
            at[open_] = at[open_] + 1 & (1 << self.bits) - 1
            now = self.keys[at[open_]]
            open_ = open_[(now != key[open_]) & (now != -1)]
        return at

    def agenda(self, part: str) -> list[int]:
        """Ids of one part."""
        return self.numbered(self.merged_long(part))

    def agendas(self, parts: list[str]) -> list[bytes]:
        """Ids of each part of up to SHORT symbols: the agendas of all parts side by side, a row each."""
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        width = int(n.max())
        inside = np.arange(width) < n[:, None]
        sym = np.full(inside.shape, -1, np.int32)
        sym[inside] = self.of_char[np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        at = np.full(inside.shape, -1, np.int64)
        at[:, :-1] = self.found(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(len(parts), -1)
        rank = np.where(at < 0, NEVER_RANK, self.ranks[at])
        after, before, alive = np.tile(np.arange(1, width + 1), (len(parts), 1)), np.tile(np.arange(-1, width - 1), (len(parts), 1)), inside.copy()
        row = np.arange(len(parts))
        while len(row):
            i = rank[row].argmin(1)  # the best pair, the leftmost of equals
            some = rank[row, i] < NEVER_RANK
            row, i = row[some], i[some]
            j = after[row, i]
            sym[row, i], alive[row, j], rank[row, j] = self.made[at[row, i]], False, NEVER_RANK
            k = after[row, i] = after[row, j]
            for left, right, r in ((i, k, row), (before[row, i], i, row)):
                ok = (left >= 0) & (right < n[r])
                rank[r[~ok & (left >= 0)], left[~ok & (left >= 0)]] = NEVER_RANK
                r, left, right = r[ok], left[ok], right[ok]
                at[r, left] = self.found(sym[r, left], sym[r, right])
                rank[r, left] = self.ranks[at[r, left]]
            ok = k < n[row]
            before[row[ok], k[ok]] = i[ok]
        plain = ((sym >= 0) & (sym < self.size) | ~alive).all(1)
        ends = np.concatenate([[0], np.cumsum(alive.sum(1))]) * 4
        out = sym[alive].tobytes()
        got = [out[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        for r in np.flatnonzero(~plain).tolist():
            got[r] = array("i", self.agenda(parts[r])).tobytes()
        return got

    def merged_long(self, part: str) -> list[str]:
        scores, sym, n = self.scores, list(part), len(part)
        if n > 1:
            heap = []
            for i in range(n - 1):
                two = sym[i] + sym[i + 1]
                if two in scores:
                    heap.append((scores[two], i, two))
            if heap:
                heapify(heap)
                nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
                while heap:
                    _, i, two = heappop(heap)
                    j = nxt[i]
                    if sym[i] is None or j >= n or sym[i] + sym[j] != two:
                        continue
                    sym[i], sym[j] = two, None
                    k = nxt[i] = nxt[j]
                    if k < n:
                        prv[k] = i
                        right = two + sym[k]
                        if right in scores:
                            heappush(heap, (scores[right], i, right))
                    h = prv[i]
                    if h >= 0:
                        left = sym[h] + two
                        if left in scores:
                            heappush(heap, (scores[left], h, left))
        return [s for s in sym if s is not None]

    def numbered(self, symbols: list[str]) -> list[int]:
        out = list(map(self.ids.get, symbols))
        if None not in out:
            return out
        out = []
        for s in symbols:
            i = self.ids.get(s)
            if i is not None:
                out.append(i)
            elif self.fallback:
                out.extend(self.bytes[b] for b in s.encode())
            else:
                out.append(self.unknown)
        return out

    def learn(self, parts: set[str]) -> dict[str, bytes]:
        """Ids of parts that are not remembered, all of them checked against the library in one call."""
        made: dict[str, bytes] = {}
        rows: dict[int, list[str]] = {}
        for p in parts:
            if len(p) <= SHORT:
                rows.setdefault((len(p) - 1) // STEP, []).append(p)
            else:
                made[p] = array("i", self.agenda(p)).tobytes()
        for same in rows.values():
            for a in range(0, len(same), ROWS):
                made.update(zip(same[a:a + ROWS], self.agendas(same[a:a + ROWS])))
        self.check(made)
        return made

    def check(self, made: dict[str, bytes]) -> None:
        """The agenda's ids against the library's.  Parts stand in one text behind a character that no piece holds, which
        nothing crosses; where there is no such character, parts are whole texts and go one by one."""
        if self.apart:
            text = self.apart.join(["", *made]).replace(MARK, " ")
            between = self.library.encode(self.apart)
            between, first = between[-len(self.apart_ids):], between[:-len(self.apart_ids)]
            want = np.array(self.library.encode(text) if made else [], np.int32).tobytes()
            if made and want != array("i", first).tobytes() + b"".join(array("i", between).tobytes() + m for m in made.values()):
                raise AssertionError("the agenda and the library differ on some of: " + repr(list(made))[:2000])
            return
        for p, m in made.items():
            if self.library.encode(p[int(self.dummy):].replace(MARK, " ")) != np.frombuffer(m, np.int32).tolist():
                raise AssertionError("the agenda and the library differ on: " + repr(p)[:2000])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as the bytes of 32-bit integers."""
        split, memory, cut = self.parts, self.memory, []
        for t in texts:
            t = t or ""
            s = (MARK if self.dummy and t else "") + t.replace(" ", MARK)
            cut.append(split(s) if split else [s] * bool(s))
        memory.turn()
        old = memory.old
        once = self.learn({p for p in set().union(*cut) if p not in memory and p not in old})
        kept = {p: v for p, v in once.items() if len(p) <= LONGEST}
        memory.update(kept)
        if len(kept) == len(once):
            return [b"".join(map(memory.__getitem__, parts)) for parts in cut]
        return [b"".join(once[p] if p in once else memory[p] for p in parts) for parts in cut]

    def decode(self, ids: list[list[int]]) -> list[str]:
        """The library's texts of lists of ids."""
        return self.library.decode(ids)


_LOADED: dict[str, Pieces] = {}


def loaded(model_path: str) -> Pieces:
    """One per worker process and model: the memory of parts outlives a task."""
    if model_path not in _LOADED:
        _LOADED[model_path] = Pieces(model_path)
    return _LOADED[model_path]


def encode_decode(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the ids of ``text`` (array of int) and the text decoded from them."""
    python_ready(df.sparkSession)
    schema = T.StructType([f for f in df.schema.fields if f.name not in (ids, decoded)] + [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])

    def run(batches):
        import pyarrow as pa

        pieces = loaded(model_path)
        for batch in batches:
            got = [c for c in batch.schema.names if c not in (ids, decoded)]
            col = batch.column(batch.schema.names.index(text))
            step = max(1, min(1000, len(batch)))
            for a in range(0, len(batch), step):
                part = pieces.encode(col.slice(a, step).to_pylist())
                values = np.frombuffer(b"".join(part), np.int32)
                ends = np.zeros(len(part) + 1, np.int32)
                np.cumsum([len(p) // 4 for p in part], out=ends[1:])
                texts = pieces.decode([values[i:j].tolist() for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())])
                cols = [batch.column(batch.schema.names.index(c)).slice(a, step) for c in got]
                yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(pa.array(ends), pa.array(values)), pa.array(texts, pa.string())], names=[*got, ids, decoded])

    return df.mapInArrow(run, schema)


def token_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text."""
    out = encode_decode(docs.select("doc_id", "text"), model_path)
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
