"""Chat formatting by columnar byte assembly.

Each turn is ``<|turn|>`` + role + newline + text + ``<|end|>`` + newline. For a batch of turns the lengths of
all segments (mark, role, newline, text, mark) are computed, their cumulative offsets give the size of one
preallocated buffer, and scatter indices copy all headers and contents into it; the buffer then backs the
Arrow column. The loss mask of a batch is the byte ranges of the assistant texts.

Control strings (of this template and of common others) inside a text or role are escaped by one more
backslash after their first character, ``<|end|>`` as ``<\\|end|>``, ``<\\|end|>`` as ``<\\\\|end|>``, and so back; in
roles newlines and backslashes are escaped too. So marks occur only where turns begin and end.

Rows are sorted by conversation and turn (ties by role, then text) into ranges; null text and null role are empty.
Ranges cut through a long conversation, so that it is formatted by many tasks. A conversation is written as parts of
whole turns whose numbers rise, so that its size is bounded nowhere; parts of a conversation stand together in each
partition. Repeated rows are turns of their own, a null conv_id is a conversation, and other columns aren't read. The
digest of the formatted texts streams over a conversation's parts in order, in one task, as its hashes run on from part
to part: it holds two hash states and three counts, whatever the size. A table without rows gives
none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.llm.common import batch_slices, prepare, text_buffers
from tandem.llm.kernels import spread

OPEN, BREAK, CLOSE = "<|turn|>", "\n", "<|end|>\n"
#: What may follow the first character of a control string: any ``<|name|>``, and the marks of other templates.
_REST = r"(\|[A-Za-z0-9_]+\|>|/?s>|/?<?SYS>>?|/?INST\])"
ESCAPE = (rf"([<\[])(\\*){_REST}", r"\1\2\\\3")
UNESCAPE = (rf"([<\[])\\(\\*){_REST}", r"\1\2\3")
PART_BYTES = 4 << 20
EXTRA = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def escape(column: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(column, *ESCAPE)


def escape_role(column: pa.Array) -> pa.Array:
    for old, new in (("\\", "\\\\"), ("\n", "\\n")):
        column = pc.replace_substring(column, old, new)
    return escape(column)


_UNESCAPE = re.compile(UNESCAPE[0])


def unescape(text: str) -> str:
    return _UNESCAPE.sub(UNESCAPE[1], text)


def unescape_role(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(text))


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with all turns, the n + 1 offsets of the turns, and the starts of their (escaped) texts."""
    role, role_at = text_buffers(escape_role(roles))
    text, text_at = text_buffers(escape(texts))
    fixed = np.frombuffer((OPEN + BREAK + CLOSE).encode(), np.uint8)
    o, b, c = len(OPEN), len(BREAK), len(CLOSE)
    n = len(roles)
    lengths = np.stack([np.full(n, o), np.diff(role_at), np.full(n, b), np.diff(text_at), np.full(n, c)], 1)
    offsets = np.zeros(5 * n + 1, np.int64)
    np.cumsum(lengths.ravel(), out=offsets[1:])
    out = np.empty(offsets[-1], np.uint8)
    at = offsets[:-1].reshape(n, 5)
    for column, source, low in ((0, fixed[:o], None), (1, role, role_at), (2, fixed[o : o + b], None), (3, text, text_at), (4, fixed[o + b :], None)):
        size = lengths[:, column]
        goal = spread(at[:, column], size)  # scatter indices of this kind of segment
        out[goal] = np.tile(source, n) if low is None else source[: low[-1]]
    return out, offsets[::5], at[:, 3]


def _format(part_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32  # ranges are in order, and so are their parts
        for batch in batch_slices(batches, "text", part_bytes):
            conv = batch.column("conv_id")
            out, turns, starts = assemble(batch.column("role"), batch.column("text"))
            ids = conv.to_pylist()
            edge = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
            loss = np.array([r == "assistant" for r in batch.column("role").to_pylist()])
            numbers, spans, bounds = [], [], []
            for low, high in zip(edge[:-1], edge[1:], strict=True):
                numbers.append(part)
                part += 1
                own = low + np.flatnonzero(loss[low:high])
                base = turns[low]
                spans.append([{"start": int(a - base), "end": int(e - base - len(CLOSE))} for a, e in zip(starts[own], turns[own + 1], strict=True)])
                bounds.append(turns[low])
            bounds.append(turns[-1])
            offsets = pa.py_buffer(np.array(bounds, np.int32))
            text = pa.Array.from_buffers(pa.string(), len(edge) - 1, [None, offsets, pa.py_buffer(out)])
            yield pa.RecordBatch.from_arrays([conv.take(pa.array(edge[:-1])), pa.array(numbers, pa.int64()), text, pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], ["conv_id", "part", "text", "loss"])

    return run


def format_chats(conversations: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """conv_id, part, text and ``loss``, the byte ranges of text under the loss mask; in the order of their numbers, a conversation's parts are its text."""
    prepare(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartitionByRange("conv_id", "turn", "role", "text").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return dealt.mapInArrow(_format(part_bytes), "conv_id long, part long, text string, loss array<struct<start: int, end: int>>")


_TURN = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*?)" + re.escape(CLOSE), re.S)


def read_back(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    turns, at = [], 0
    for m in _TURN.finditer(text):
        if m.start() != at:
            raise ValueError("text between turns")
        turns.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(text):
        raise ValueError("text after the last turn")
    return turns


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams over the parts: what is held of a conversation is two hashes and three counts."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    state: list | None = None
    for batch in batches:
        done = []
        for conv, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss")), strict=True):
            if state is None or state[0] != conv:
                if state:
                    done.append(state)
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, own in read_back(text):
                state[1] += 1
                state[2].update(f"{role}\n{own}\n".encode())
            raw = text.encode()
            for span in loss:
                own = unescape(raw[span["start"] : span["end"]].decode())
                state[3] += len(own)
                state[4].update(own.encode())
            state[5] += len(text)
        if done:
            yield _digests(done, names, kinds)
    if state:
        yield _digests([state], names, kinds)


def _digests(done: list[list], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    rows = [[c, n, t.hexdigest(), k, x.hexdigest(), f] for c, n, t, k, x, f in done]
    return pa.RecordBatch.from_arrays([pa.array(list(v), kind) for v, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def with_probe(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The conversations plus -7, whose two texts are control strings of another template."""
    extra = spark.createDataFrame(EXTRA, "conv_id long, turn long, role string, text string")
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(extra)


def chat_digest(conversations: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the formatted texts."""
    parts = format_chats(conversations, part_bytes).repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return parts.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def chat_sql() -> str:
    """The digests as DuckDB SQL over ``conversations``."""
    rest = _REST
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_replace(text, '([<\\[])(\\\\*){rest}', '\\1\\2\\\\\\3', 'g') AS etext,
    regexp_replace(replace(replace(role, '\\', '\\\\'), chr(10), '\\n'), '([<\\[])(\\\\*){rest}', '\\1\\2\\\\\\3', 'g') AS erole
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(length(etext) + length(erole) + {len(OPEN) + len(BREAK) + len(CLOSE)}) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""
