"""Chat formatting by columnar byte assembly.

A turn becomes header, escaped text and footer. For a batch of turns the lengths of these segments give cumulative offsets, the offsets
give the place of every byte, and headers, footers and texts are scattered into one preallocated buffer that is the Arrow column's own.
Inside texts (and role names) a backslash goes before every backslash, '[' and '<'; all control strings begin with '[' or '<', so that
none can stand in a text, and taking the backslashes away gives the text back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ESCAPED = b"\\[<"
USER, SYSTEM, ASSISTANT = ("[INST] ", " [/INST]"), ("[SYS] ", " [/SYS]"), ("[ASSISTANT] ", "</s>")
KNOWN = {"user": USER, "system": SYSTEM, "assistant": ASSISTANT}
OTHER = ("[ROLE] {}[TEXT] ", " [/ROLE]")
#: A turn as written: its control strings, and between them nothing that begins one.
TEXT = r"((?:[^\\\[<]|\\[\\\[<])*)"
TURN = re.compile("|".join(re.escape(a).replace(r"\{\}", TEXT) + TEXT + re.escape(b) for a, b in (USER, SYSTEM, ASSISTANT, OTHER)), re.S)
FORMATTED = "conv_id long, turn long, formatted string, loss_start int, loss_end int"


def escape(text: str) -> str:
    return re.sub(r"[\\\[<]", r"\\\g<0>", text)


def unescape(text: str) -> str:
    return re.sub(r"\\([\\\[<])", r"\1", text)


def frame(role: str) -> tuple[str, str]:
    return KNOWN.get(role) or (OTHER[0].format(escape(role)), OTHER[1])


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and offsets, from its Arrow buffers."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For consecutive segments, the place of each of their bytes when the segments go to these starts."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(sizes.sum())


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The formatted turns, and where in each (in bytes) the escaped text begins and ends."""
    n = len(texts)
    coded = roles.dictionary_encode()
    frames = [tuple(x.encode() for x in frame(r)) for r in coded.dictionary.to_pylist()]
    which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    head_raw, foot_raw = (np.frombuffer(b"".join(f[k] for f in frames), dtype=np.uint8) for k in (0, 1))
    heads, feet = (np.array([len(f[k]) for f in frames], dtype=np.int64) for k in (0, 1))
    raw, at = _bytes_of(texts)
    marked = np.isin(raw, np.frombuffer(ESCAPED, dtype=np.uint8))
    marks = np.concatenate([[0], np.cumsum(marked)])
    body = np.diff(at) + np.diff(marks[at])
    head, foot = heads[which], feet[which]
    ends = np.cumsum(head + body + foot)
    starts = ends - head - body - foot
    out = np.empty(int(ends[-1]) if n else 0, dtype=np.uint8)
    for raw_frames, sizes, size, begin in ((head_raw, heads, head, starts), (foot_raw, feet, foot, starts + head + body)):
        first = np.cumsum(sizes) - sizes
        out[_spread(begin, size)] = raw_frames[_spread(first[which], size)]
    place = np.repeat(starts + head - at[:-1] - marks[at[:-1]], np.diff(at)) + np.arange(len(raw)) + marks[1:]
    out[place] = raw
    out[place[marked] - 1] = ord("\\")
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    column = pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(out)).cast(pa.string())
    return column, head, head + body


def format_turns(turns: DataFrame) -> DataFrame:
    """A row for each turn: conv_id, turn, formatted, and loss_start and loss_end: which bytes of it the loss covers (an assistant's escaped text; else null).

    A conversation is the concatenation of its turns' strings by turn. Turns are formatted where they lie, without a shuffle, so that a
    conversation of any length takes no more memory than a batch. A null text or role counts as empty; roles other than user, system and
    assistant are written out. Other columns are dropped; an empty table gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            formatted, begin, end = assemble(batch.column("role"), batch.column("text"))
            said = np.array([r == "assistant" for r in batch.column("role").to_pylist()], dtype=bool)
            span = [pa.array(x.astype(np.int32), pa.int32(), mask=~said) for x in (begin, end)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), formatted, *span], ["conv_id", "turn", "formatted", "loss_start", "loss_end"])

    empty = lambda c: F.coalesce(turns[c].cast("string"), F.lit("")).alias(c)
    return turns.select(turns["conv_id"].cast("long").alias("conv_id"), turns["turn"].cast("long").alias("turn"), empty("role"), empty("text")).mapInArrow(run, FORMATTED)


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    found = TURN.fullmatch(formatted)
    if not found:
        raise ValueError("not a formatted turn")
    user, system, assistant, role, text = found.groups()
    for name, said in (("user", user), ("system", system), ("assistant", assistant)):
        if said is not None:
            return name, unescape(said)
    return unescape(role), unescape(text)


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations say when they are read back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Turns go by turn (null first), ties by their formatted string. Digests are fed turn by turn from sorted partitions, so that a long
    conversation is never held; as a digest has one order, a conversation is read by one task. Null conv_ids are one conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows = None, []

        def close() -> None:
            if current:
                conv, n, said, chars, loss, total = current
                rows.append((conv, n, said.hexdigest(), chars, loss.hexdigest(), total))

        for batch in batches:
            for conv, text, begin, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end")), strict=True):
                if current is None or current[0] != conv:
                    close()
                    current = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, plain = read_turn(text)
                current[1] += 1
                current[2].update(f"{role}\n{plain}\n".encode())
                if begin is not None:
                    masked = unescape(text.encode()[begin:end].decode())
                    current[3] += len(masked)
                    current[4].update(masked.encode())
                current[5] += len(text)
            if rows:
                yield out(rows)
                rows = []
        close()
        if rows:
            yield out(rows)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        conv, n, said, chars, loss, total = map(list, zip(*rows, strict=True))
        long = lambda x: pa.array(x, pa.int64())
        return pa.RecordBatch.from_arrays([long(conv), long(n), pa.array(said), long(chars), pa.array(loss), long(total)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    dealt = formatted.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "formatted")
    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    trap = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", trap), (-7, 1, "assistant", trap)], "conv_id long, turn long, role string, text string")
    return digests(format_turns(turns.unionByName(own)))


SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
sized AS (SELECT *, len(text) + len(regexp_replace(text, '[^\\\[<]', '', 'g')) + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 16
                 ELSE 22 + len(role) + len(regexp_replace(role, '[^\\\[<]', '', 'g')) END AS size FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(size)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
