"""Chat formatting with offset-aligned loss masks.

A turn is rendered as ``[INST]role[/INST]text</s>``. Control strings inside
roles and texts are escaped reversibly (a backslash is put after their first
character, one more for each that is there already), so a rendered
conversation can be parsed back. Consecutive turns are rendered into one
string, encoded once with offsets (the control strings are special tokens, so
no token crosses a turn's edge), and the sorted spans of loss-bearing texts are
intersected with the sorted token spans by binary search.

A conversation is formatted in segments of at most ``turns_per_segment`` rows
and ``SEGMENT_CHARS`` characters (or one longer row): rendering and encoding
commute with cutting at a control string. Rows are dealt by ranges of their
order, equal rows by a row id, so one conversation that holds a large part of
all rows is spread over many tasks whatever its turn numbers. Segment numbers
ascend in a conversation's order; they need not follow each other.

Defined results: a null text or role is the empty string; null conversation
ids form one conversation; null turns come first; ties in ``turn`` are ordered
by role and text, repeated rows are all kept; an empty table gives no rows.
Only the four named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, list_column, load_tokenizer, tokenizer_source

#: The template's control strings. Fixed values.
OPEN, MID, CLOSE = "[INST]", "[/INST]", "</s>"
_CONTROL = re.compile(r"([\[<])(\\*)(?=/?INST\]|/s>)")
_ESCAPED = re.compile(r"([\[<])\\(\\*)(?=/?INST\]|/s>)")
_TURN = re.compile(re.escape(OPEN) + "(.*?)" + re.escape(MID) + "(.*?)" + re.escape(CLOSE), re.S)

#: Characters of a segment, and of the segments that are encoded together, at most (beyond one longer row).
SEGMENT_CHARS = 2_000_000

SEGMENT_SCHEMA = ("conv_id bigint, segment bigint, n_turns bigint, formatted string, "
                  "ids array<int>, token_start array<int>, token_end array<int>, loss array<byte>")


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def render(turns: list[tuple[str, str]], loss_roles: tuple[str, ...]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted string and the sorted spans of the texts that bear loss."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = OPEN + escape(role) + MID, escape(text)
        if role in loss_roles:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, CLOSE)
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Turns read back from a formatted string."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def loss_mask(spans: list[tuple[int, int]], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """1 for each token whose span meets a loss span: two binary searches per span over the sorted tokens."""
    mask = np.zeros(len(start) + 1, np.int32)
    if spans:
        s = np.array(spans, np.int64)
        s = s[s[:, 1] > s[:, 0]]
        first = np.searchsorted(end, s[:, 0], "right")   # first token that ends after the span begins
        after = np.searchsorted(start, s[:, 1], "left")  # first token that starts at the span's end or later
        np.add.at(mask, first, 1)
        np.add.at(mask, after, -1)
    return (np.cumsum(mask[:-1]) > 0).astype(np.int8)


def masked_texts(formatted: str, start: np.ndarray, end: np.ndarray, loss: np.ndarray) -> str:
    """The characters under the mask, unescaped: every run of masked tokens is one stretch of text."""
    edge = np.diff(np.concatenate([[0], loss.astype(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    return "".join(unescape(formatted[start[a]:end[b]]) for a, b in zip(first, last, strict=True))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True)


def format_conversations(turns: DataFrame, tokenizer: str, loss_roles: tuple[str, ...] = ("assistant",),
                         turns_per_segment: int = 64, id_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Segments of conversations: formatted string, token ids, token spans (code points) and the loss mask per token."""
    spark = turns.sparkSession
    bounded_batches(spark)
    source = tokenizer_source(spark, tokenizer, (OPEN, MID, CLOSE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load_tokenizer(source)
        conv_now, own, done, size, waiting = None, [], [], 0, 0
        segment = TaskContext.get().partitionId() << 32

        def out() -> pa.RecordBatch:
            rendered = [render(t, loss_roles) for _, t in done]
            encoded = tok.encode_batch([r[0] for r in rendered], add_special_tokens=False)
            spans = [np.array(e.offsets, np.int32).reshape(-1, 2) for e in encoded]
            marks = [loss_mask(r[1], s[:, 0], s[:, 1]) for r, s in zip(rendered, spans, strict=True)]
            made = pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k, _ in done], pa.int64()), pa.array([k[1] for k, _ in done], pa.int64()),
                 pa.array([len(t) for _, t in done], pa.int64()), pa.array([r[0] for r in rendered], pa.string()),
                 list_column([np.array(e.ids, np.int32) for e in encoded], pa.int32()),
                 list_column([s[:, 0] for s in spans], pa.int32()), list_column([s[:, 1] for s in spans], pa.int32()),
                 list_column(marks, pa.int8())],
                ["conv_id", "segment", "n_turns", "formatted", "ids", "token_start", "token_end", "loss"])
            done.clear()
            return made

        for conv, role, text in _rows(batches):
            role, text = role or "", text or ""
            n = len(role) + len(text)
            if own and (conv != conv_now or len(own) >= turns_per_segment or size + n > SEGMENT_CHARS):
                done.append(((conv_now, segment), own))
                segment, waiting = segment + 1, waiting + size
                own, size = [], 0
                if len(done) == 256 or waiting + n > SEGMENT_CHARS:
                    yield out()
                    waiting = 0
            conv_now = conv
            own.append((role, text))
            size += n
        if own:
            done.append(((conv_now, segment), own))
        if done:
            yield out()

    rows = turns.select(F.col(id_col).cast("bigint").alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"),
                        F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    order = ("conv_id", "turn", "role", "text")
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order, "row").sortWithinPartitions(*order)
    return dealt.select("conv_id", "role", "text").mapInArrow(run, SEGMENT_SCHEMA)


DIGEST_SCHEMA = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
                 "formatted_chars bigint, n_tokens bigint, loss_tokens bigint")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of whole conversations over their segments in order; only running hashes are held."""
    made, key, at = [], None, None

    def close() -> None:
        made.append((key, at[0], at[1].hexdigest(), at[2], at[3].hexdigest(), at[4], at[5], at[6]))

    def batch() -> pa.RecordBatch:
        names = [c.split(" ")[0] for c in DIGEST_SCHEMA.split(", ")]
        kinds = [pa.string() if n.endswith("sha256") else pa.int64() for n in names]
        cols = list(zip(*made, strict=True)) if made else [[]] * len(names)
        made.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    for conv, formatted, start, end, loss in _rows(batches):
        if at is None or conv != key:
            if at is not None:
                close()
                if len(made) == 1000:
                    yield batch()
            key, at = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
        turns, mask = parse(formatted), np.array(loss, np.int8)
        under = masked_texts(formatted, np.array(start, np.int64), np.array(end, np.int64), mask)
        at[1].update("".join(f"{r}\n{t}\n" for r, t in turns).encode())
        at[3].update(under.encode())
        for i, v in ((0, len(turns)), (2, len(under)), (4, len(formatted)), (5, len(mask)), (6, int(mask.sum()))):
            at[i] += v
    if at is not None:
        close()
    if made:
        yield batch()


def conversation_digests(segments: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted segments: turns and loss-text digests, lengths, token counts.

    A digest of a whole conversation is sequential, so its segments pass one
    task in order; the task holds one segment and two hash states.
    """
    rows = segments.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return rows.select("conv_id", "formatted", "token_start", "token_end", "loss").mapInArrow(_digests, DIGEST_SCHEMA)
