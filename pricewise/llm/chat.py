r"""Chat formatting by token-level assembly.

Each segment of a conversation (role name, turn text) is encoded by itself with a byte-level
vocabulary; reserved ids above the vocabulary are spliced in as turn marks, so no text can produce
one.  The loss mask is the difference of two prefix sums over the assembled ids: +1 where an
assistant text starts, -1 where it ends.

The formatted text marks a turn as ``### <Role>: text </turn>`` + newline.  Control strings inside a
text are escaped reversibly before encoding: every run of backslashes that stands directly before
``###`` or ``</turn>`` is doubled and one backslash is added; reading back undoes that.

A conversation is never gathered: rows are dealt by conversation, sorted by turn inside each
partition, and streamed through Arrow batches; only running digests and counts are held per
conversation, so one with a third of all rows costs time, not memory.

Defined cases: null text = empty text; null role = role ``""`` (no loss); ties of turn are ordered by
role, then text; repeated rows are turns of their own; rows with null conv_id form one conversation
with a null id; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewise.llm.common import python_ready

CONTROL = re.compile(r"(\\*)(###|</turn>)")
OPEN, CLOSE = "### ", " </turn>\n"
#: Reserved ids follow the vocabulary, in this order.
RESERVED = ("<turn>", "<text>", "</turn>")


def escaped(text: str) -> str:
    return CONTROL.sub(lambda m: m[1] * 2 + "\\" + m[2], text)


def unescaped(text: str) -> str:
    return CONTROL.sub(lambda m: m[1][:len(m[1]) // 2] + m[2], text)


class Assembler:
    """Byte-level encoding of segments and the reserved ids around them."""

    def __init__(self, ranks_path: str, pattern: str):
        import base64

        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.enc = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.first = max(ranks.values()) + 1
        self.turn, self.text, self.close = range(self.first, self.first + 3)

    def turn_ids(self, role: str, text: str) -> tuple[list[int], list[int]]:
        """Ids of one turn and the steps of its mask (+1 and -1 by position, one longer than the ids)."""
        head = [self.turn, *self.enc.encode_ordinary(role), self.text]
        body = self.enc.encode_ordinary(escaped(text))
        ids = [*head, *body, self.close]
        steps = [0] * (len(ids) + 1)
        if role == "assistant":
            steps[len(head)] += 1
            steps[len(head) + len(body)] -= 1
        return ids, steps

    def read(self, ids: list[int]) -> tuple[str, str, str]:
        """Role, text and formatted text of the ids of one turn."""
        if ids[0] != self.turn or ids[-1] != self.close:
            raise ValueError("not one whole turn")
        k = ids.index(self.text)
        role, body = self.enc.decode(ids[1:k]), self.enc.decode(ids[k + 1:-1])
        return role, unescaped(body), f"{OPEN}{role.capitalize()}: {body}{CLOSE}"


_LOADED: dict[str, Assembler] = {}


def loaded(ranks_path: str, pattern: str) -> Assembler:
    if ranks_path not in _LOADED:
        _LOADED[ranks_path] = Assembler(ranks_path, pattern)
    return _LOADED[ranks_path]


def encoded_turns(conversations: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """One row per turn, where it stands: conv_id, turn, role, text, ids, loss_mask (0/1 per id)."""
    python_ready(conversations.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        a = loaded(ranks_path, pattern)
        for b in batches:
            ids, masks = [], []
            for role, text in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                i, steps = a.turn_ids(role, text)
                ids.append(i)
                masks.append(np.cumsum(steps[:-1]).astype(np.int8))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.int8()))], names=["conv_id", "turn", "role", "text", "ids", "loss_mask"])

    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "conv_id bigint, turn bigint, role string, text string, ids array<int>, loss_mask array<tinyint>")


def read_turns(turns: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """What ids and masks say, each decoded once: conv_id, turn, role, text, loss (text under the mask; null if it is
    the whole text), formatted, n_tokens, loss_tokens."""
    def run(batches):
        import pyarrow as pa

        a = loaded(ranks_path, pattern)
        for b in batches:
            rows = []
            for ids, mask in zip(b.column(2), b.column(3)):
                ids, mask = ids.values.to_numpy(), mask.values.to_numpy().astype(bool)
                role, text, formatted = a.read(ids.tolist())
                loss = unescaped(a.enc.decode(ids[mask].tolist()))
                rows.append((role, text, None if loss == text else loss, formatted, len(ids), int(mask.sum())))
            cols = list(zip(*rows)) if rows else [()] * 6
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=["conv_id", "turn", "role", "text", "loss", "formatted", "n_tokens", "loss_tokens"])

    return turns.select("conv_id", "turn", "ids", "loss_mask").mapInArrow(run, "conv_id bigint, turn bigint, role string, text string, loss string, formatted string, n_tokens bigint, loss_tokens bigint")


def in_order(turns: DataFrame) -> DataFrame:
    """Dealt by conversation, in order within each."""
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_turns(conversations: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """One row per turn in order: conv_id, turn, ids, loss_mask (0/1 per id), formatted text.  Turns are encoded where
    they stand, before they are dealt, so a conversation of any length is encoded by all tasks."""
    turns = encoded_turns(conversations, ranks_path, pattern)

    def run(batches):
        import pyarrow as pa

        a = loaded(ranks_path, pattern)
        for b in batches:
            texts = [a.read(ids)[2] for ids in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "formatted"])

    made = turns.mapInArrow(run, "conv_id bigint, turn bigint, role string, text string, ids array<int>, loss_mask array<tinyint>, formatted string")
    return in_order(made).select("conv_id", "turn", "ids", "loss_mask", "formatted")


def conversation_digests(conversations: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per conversation, read back from ids and mask: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens, loss_tokens.

    Encoding and reading back are done turn by turn before the shuffle; only the digests, which need the order,
    run behind it."""
    read = read_turns(encoded_turns(conversations, ranks_path, pattern), ranks_path, pattern)
    turns = in_order(read.withColumn("formatted_chars", F.char_length("formatted")).drop("formatted"))

    def run(batches):
        import pyarrow as pa

        state, out = None, []

        def done():
            if state is not None:
                c, n, t, lc, ls, fc, nt, lt = state
                out.append((c, n, t.hexdigest(), lc, ls.hexdigest(), fc, nt, lt))

        def batch():
            cols = list(zip(*out)) if out else [()] * 8
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "loss_tokens"])
            out.clear()
            return made

        for b in batches:
            for conv, role, text, loss, n_tokens, loss_tokens, formatted_chars in zip(*[c.to_pylist() for c in b.columns]):
                if state is None or state[0] != conv:
                    done()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                loss = text if loss is None else loss
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                state[3] += len(loss)
                state[4].update(loss.encode())
                state[5] += formatted_chars
                state[6] += n_tokens
                state[7] += loss_tokens
            if len(out) >= 5000:
                yield batch()
        done()
        yield batch()

    return turns.drop("turn").mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_tokens bigint, loss_tokens bigint")
