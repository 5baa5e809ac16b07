"""Token counts by a whole-token shortcut.

Which vocabulary strings encode alone as one token is proved offline, once on the driver, by running the library's merges over each of them:
a pre-token equal to such a string counts one without any merging. Only the other distinct pre-tokens are merged, once for each worker's
memo. The list of proved strings is bounded by the vocabulary (half a megabyte) and travels with the tasks.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .bpe import steps
from .common import text_or_empty
from .pretokens import splitter

MEMO_WORDS = 200_000
LIMIT = 1024


def byte_letters() -> dict[int, str]:
    """The printable letter that a byte-level vocabulary file writes for each byte: itself if it is a visible Latin-1 sign, else the next code point from 256 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}


@lru_cache(2)
def proved(path: str) -> frozenset[str]:
    """The vocabulary's strings that the merges leave as one token, as text. Parts of characters are left out: no pre-token is equal to one."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    merge, raw, out = Tokenizer.from_file(path).model.tokenize, {c: b for b, c in byte_letters().items()}, set()
    for token in vocab:
        if all(c in raw for c in token) and len(merge(token)) == 1:
            try:
                out.add(bytes(raw[c] for c in token).decode())
            except UnicodeDecodeError:
                continue
    return frozenset(out)


class Counter:
    """Counts tokens as the library does for a byte-level BPE file without normaliser: added tokens are cut out of the text first, the rest is split and merged."""

    def __init__(self, path: str, pattern: str, one: frozenset[str]):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, kind = spec["model"], spec["pre_tokenizer"]
        if spec["normalizer"] or kind["type"] != "ByteLevel" or kind["add_prefix_space"] or model["ignore_merges"] or any(t[x] for t in spec["added_tokens"] for x in ("lstrip", "rstrip", "single_word")):
            raise ValueError("only plain byte-level BPE files are counted here")
        self.split = splitter(pattern)
        added = sorted((t["content"] for t in spec["added_tokens"]), key=lambda s: (-len(s), s))
        # leftmost, and the longest of those that begin there, as the library cuts
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        letters = byte_letters()
        self.memo = Sizes(one, Tokenizer.from_file(path).model.tokenize, {b: letters[b] for b in range(256)})

    def pieces(self, text: str) -> tuple[int, list[str]]:
        """Number of added tokens in the text, and the pre-tokens between them."""
        parts = self.added.split(text) if self.added else [text]
        if len(parts) == 1:
            return 0, self.split(text)
        return len(parts) - 1, [w for p in parts for w in self.split(p)]

    def count(self, texts: list[str]) -> list[int]:
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        return [n + sum(map(self.memo.__getitem__, words)) for n, words in map(self.pieces, texts)]


class Sizes(dict):
    """How many tokens a pre-token has: one for a proven string, or what is left when it is merged."""

    def __init__(self, one: frozenset[str], merge, table: dict[int, str]):
        self.one, self.merge, self.table = one, merge, table

    def __missing__(self, word: str) -> int:
        n = 1 if word in self.one else len(self.merge("".join(map(self.table.__getitem__, word.encode()))))
        self[word] = n
        return n


_COUNTERS: dict[tuple[str, str], Counter] = {}


def counter(path: str, pattern: str, one: frozenset[str]) -> Counter:
    """One counter for each vocabulary and Python worker; tasks that follow reuse it."""
    if (path, pattern) not in _COUNTERS:
        _COUNTERS[path, pattern] = Counter(path, pattern, one)
    return _COUNTERS[path, pattern]


def token_counts(docs: DataFrame, path: str, pattern: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of every row.

    A null text counts as empty: no bytes, no tokens. Repeated rows and null doc_ids each give a row; other columns are dropped; an empty
    table gives no row. There is no shuffle, and a worker's memo of words is emptied when it is full.
    """

    one = docs.sparkSession.sparkContext.broadcast(proved(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path, pattern, one.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for at, end in steps(texts):
                counts = c.count(texts[at:end])
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(at, end - at),
                    "n_bytes": pa.array([len(t.encode()) for t in texts[at:end]], pa.int64()),
                    "n_tokens": pa.array(counts, pa.int64()),
                    "over_limit": pa.array([n > limit for n in counts]),
                })

    schema = T.StructType().add("doc_id", "long").add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty("text").alias("text")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
