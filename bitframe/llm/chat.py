"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole and encoded once with offsets; the sorted spans of the assistant's texts are intersected with
the token spans by binary search. Markers are tokens of their own, so no token lies across the edge of a text. Control strings
inside texts and roles get a backslash after their first character, and backslashes are doubled, which is undone on reading.
Conversations are streamed in the order of turns within a partition, and encoded in parts, cut at turns, where they are very long: no token lies across a turn's
marker, and offsets count from the beginning of the conversation, so its parts one after the other are what encoding it at once would give.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import arrow

OPEN, ROLE, SAY, END = "<|open|>", "<|role|>", "<|say|>", "<|end|>"
CONTROL = re.compile(r"(?=<\||</?s>|\[/?INST\])(.)")
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
PART = 250_000  # characters after which a conversation goes on in another part; encoding takes about 180 bytes of memory for each
BATCH = 500_000


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    """Two backslashes are one; a single one was put in."""
    return re.sub(r"\\(\\?)", r"\1", text)


@functools.lru_cache(1)
def load(path: str):  # noqa: ANN201
    """The tokenizer, loaded once by each worker process, with the markers as tokens, and offsets that keep spaces."""
    from tokenizers import AddedToken, Tokenizer, processors

    out = Tokenizer.from_file(path)
    out.add_special_tokens([AddedToken(m, special=True, normalized=False) for m in (OPEN, ROLE, SAY, END)])
    out.post_processor = processors.ByteLevel(trim_offsets=False)
    return out


def render(turns: list[tuple[str, str]], opens: bool = True) -> tuple[str, np.ndarray]:
    """The text of turns, and the spans of the assistant's texts in it, sorted."""
    parts, spans, at = [OPEN] if opens else [], [], len(OPEN) * opens
    for role, text in turns:
        head, body = f"{ROLE}{escape(role)}{SAY}", escape(text)
        at += len(head)
        if role == "assistant":
            spans.append((at, at + len(body)))
        at += len(body) + len(END)
        parts += [head, body, END]
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def loss_mask(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens lie in a span: a token's first span that ends after its start is found by binary search."""
    if not len(spans) or not len(offsets):
        return np.zeros(len(offsets), bool)
    i = np.searchsorted(spans[:, 1], offsets[:, 0], "right")
    return (i < len(spans)) & (spans[np.minimum(i, len(spans) - 1), 0] < offsets[:, 1])


def read_back(text: str) -> list[tuple[str, str]]:
    """Turns from rendered text."""
    return [(unescape(role), unescape(said)) for role, said in re.findall(re.escape(ROLE) + "(.*?)" + re.escape(SAY) + "(.*?)" + re.escape(END), text, re.S)]


def placed(turns: DataFrame) -> DataFrame:
    """conv_id, role, text: a conversation's turns in order within one partition."""
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def encoded(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[pa.RecordBatch]:
    """The rows of format_conversations() from a partition of placed()."""
    model = load(tokenizer)
    waiting: list[tuple] = []

    def emit() -> pa.RecordBatch:
        ids, spans = [], []
        for w in waiting:  # an encoding takes far more memory than its arrays, so only one is held
            code = model.encode(w[2], add_special_tokens=False)
            ids.append(np.array(code.ids, np.int32))
            spans.append(np.array(code.offsets, np.int32).reshape(-1, 2))
            del code
        masks = [loss_mask(o.astype(np.int64), w[3]) for o, w in zip(spans, waiting)]
        places = [o.astype(np.int64) + w[4] for o, w in zip(spans, waiting)]
        out = pa.RecordBatch.from_arrays(
            [
                pa.array([w[0] for w in waiting], pa.int64()), pa.array([w[1] for w in waiting], pa.int32()), pa.array([w[2] for w in waiting], pa.string()),
                pa.array(ids, pa.list_(pa.int32())), pa.array([o[:, 0] for o in places], pa.list_(pa.int64())),
                pa.array([o[:, 1] for o in places], pa.list_(pa.int64())), pa.array(masks, pa.list_(pa.bool_())),
            ],
            ["conv_id", "part", "text", "ids", "starts", "ends", "mask"],
        )
        waiting.clear()
        return out

    here, part, held, size, queued, before = None, -1, [], 0, 0, 0  # before: characters of the conversation's parts so far

    def put() -> None:
        nonlocal before
        said, own = render(held, part == 0)
        waiting.append((here, part, said, own, before))
        before += len(said)

    for batch in batches:
        for i in range(0, len(batch), 1024):
            for conv, role, text in zip(*(c[i : i + 1024].to_pylist() for c in batch.columns)):
                if part >= 0 and (conv != here or size > PART):
                    put()
                    part, held, queued, size = part + 1, [], queued + size, 0
                if part < 0 or conv != here:
                    here, part, before = conv, 0, 0
                held.append((role, text))
                size += len(text) + len(role) + 32
                if queued > BATCH:
                    yield emit()
                    queued = 0
    if part >= 0:
        put()
        yield emit()


def format_conversations(turns: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """conv_id, part, text, ids, starts, ends, mask: one row per conversation, or more in order if it is very long.

    Turns are ordered by turn, then role and text; repeated rows are turns of their own. Null texts and roles are empty; a null turn comes first; rows
    without a conv_id are one conversation. Offsets count code points of the conversation's text, all its parts in order; a turn is never cut.
    """
    return arrow(placed(turns), lambda rows: encoded(rows, tokenizer), "conv_id bigint, part int, text string, ids array<int>, starts array<bigint>, ends array<bigint>, mask array<boolean>")


def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The contract's columns, read back from rows of format_conversations() that hold each conversation's parts in order."""
    here, state, done = None, None, []

    def close() -> None:
        if state:
            done.append((here, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

    def flush() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
        done.clear()
        return out

    for batch in batches:
        conv, part, text, starts, ends, mask = (batch.column(c) for c in ("conv_id", "part", "text", "starts", "ends", "mask"))
        for i in range(len(batch)):
            if part[i].as_py() == 0:
                close()
                here, state = conv[i].as_py(), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            said = text[i].as_py()
            for role, words in read_back(said):
                state[0] += 1
                state[1].update(f"{role}\n{words}\n".encode())
            on = np.array(mask[i].values, bool)
            a, b = starts[i].values.to_numpy()[on] - state[4], ends[i].values.to_numpy()[on] - state[4]
            if len(a):
                reach = np.maximum.accumulate(np.concatenate([[0], b[:-1]]))  # tokens of one character share its offsets
                new = np.flatnonzero(a > reach)  # where a token doesn't follow on another
                new = np.unique(np.concatenate([[0], new]))
                under = "".join(unescape(said[x:y]) for x, y in zip(a[new].tolist(), np.maximum.reduceat(b, new).tolist()))
                state[2] += len(under)
                state[3].update(under.encode())
            state[4] += len(said)
        if done:
            yield flush()
    close()
    if done:
        yield flush()


def report(conversations: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """The contract's columns of all conversations, and number -1, in which both sides say control strings; turns of a -1 in the table are turns of it.

    Formatting and reading back follow each other in one worker, so the formatted rows don't pass through the JVM.
    """
    said = "</s>[INST] ok [/INST]"
    own = conversations.sparkSession.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    turns = placed(conversations.select("conv_id", "turn", "role", "text").unionByName(own))
    kinds = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return arrow(turns, lambda rows: digested(encoded(rows, tokenizer)), kinds)
