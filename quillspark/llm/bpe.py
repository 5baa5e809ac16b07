"""Byte-level BPE encoding and decoding as recursive DuckDB queries inside each partition.

Encoding: a text is split into pre-tokens; the distinct pre-tokens of a batch that no earlier batch of the worker has seen go to a
DuckDB query. Its recursive part lays every word out as token-position rows, joins neighbouring pairs with the merge table, takes each
word's leftmost pair of least rank, contracts it, and repeats until no pair of any word is in the table. Decoding is an ordered
aggregation of the vocabulary's bytes.

Memory is bounded: a query sees at most WORDS_A_QUERY words whose squared lengths sum to SQUARES_A_QUERY at most, as a word's states are kept
until its query ends, and never spills; the worker's memo of words drops the rarer half when it is full.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .bytespans import trim
from .common import text_or_empty
from .pretokens import splitter

WORDS_A_QUERY, SQUARES_A_QUERY = 10_000, 4_000_000
MEMO_WORDS = 250_000
#: Each contraction copies a word's tokens, so that the query costs the square of a word's length. Longer words than this (bytes) are cut where
#: no token of the vocabulary can lie across; parts that are longer still are contracted in the same order by a heap.
LONG_WORD = 36
CHARS_A_STEP = 1_000_000
EMPTY = np.zeros(0, dtype="<u4")

ENCODE = """
WITH RECURSIVE state(wid, toks) AS (
  SELECT wid, toks FROM words
  UNION ALL
  SELECT state.wid,
         list_concat(list_append(toks[:(best & 1099511627775) - 1], (best >> 40)::INTEGER), toks[(best & 1099511627775) + 2:])
  FROM state JOIN (
    SELECT wid, min((merged::BIGINT << 40) | pos) AS best
    FROM (SELECT wid, unnest(toks[:-2]) AS lhs, unnest(toks[2:]) AS rhs, generate_subscripts(toks[2:], 1) AS pos FROM state) AS places
    JOIN merges ON merges.pair = (lhs::BIGINT << 32) | rhs
    GROUP BY wid) AS found ON found.wid = state.wid)
SELECT wid, arg_min(toks, len(toks)) AS toks FROM state GROUP BY wid ORDER BY wid
"""
DECODE = """
SELECT sid, string_agg(piece, '' ORDER BY pos) AS bytes
FROM (SELECT sid, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM seqs) AS places JOIN vocab USING (tok)
GROUP BY sid ORDER BY sid
"""


class Codec:
    """A rank file's vocabulary in an in-memory DuckDB database of one thread, with memos of words and of decoded token runs."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = splitter(pattern)
        ranks = self.ranks
        rows = np.array([(ranks[k[:i]], ranks[k[i:]], v) for k, v in ranks.items() for i in range(1, len(k)) if k[:i] in ranks and k[i:] in ranks], dtype=np.int64)
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.known = np.zeros(max(ranks.values()) + 1, dtype=bool)
        self.known[list(ranks.values())] = True
        # pairs of bytes that stand next to each other in some token: between any two others no token lies across
        self.inside = np.zeros(1 << 16, dtype=bool)
        flat = np.frombuffer(b"".join(ranks), dtype=np.uint8).astype(np.int32)
        within = np.ones(len(flat), dtype=bool)
        within[np.cumsum([len(k) for k in ranks]) - 1] = False
        self.inside[((flat[:-1] << 8) | flat[1:])[within[:-1]]] = True
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "200MB", "temp_directory": ""})
        self._table("merges", pa.table({"pair": (rows[:, 0] << 32) | rows[:, 1], "merged": pa.array(rows[:, 2], pa.int32())}))
        # a byte string as text of code points 0 to 255: ordered string_agg takes text
        self._table("vocab", pa.table({"tok": pa.array(list(ranks.values()), pa.int32()), "piece": [k.decode("latin-1") for k in ranks]}))
        self.forget()

    def forget(self) -> None:
        """Empties the memo: words by number with how often they were met, and for each number a stretch of ids and, once asked for, of decoded bytes."""
        self.index, self.met = Numbers(), np.zeros(0, dtype=np.int64)
        self.ids, self.id_cut = np.zeros(0, dtype="<u4"), np.zeros(1, dtype=np.int64)
        self.raw, self.raw_cut = np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)

    def forget_rare(self) -> None:
        """Keeps the half of the memo that was met most, and counts half of how often."""
        if len(self.raw_cut) > 1:
            self.decode_known()
        stays = np.sort(np.argsort(-self.met, kind="stable")[: MEMO_WORDS // 2])
        words, one = list(self.index), np.arange(len(stays) + 1)
        self.index = Numbers((words[k], n) for n, k in enumerate(stays.tolist()))
        self.ids, self.id_cut = stretches(self.ids, self.id_cut, stays, one)
        if len(self.raw_cut) > 1:
            self.raw, self.raw_cut = stretches(self.raw, self.raw_cut, stays, one)
        self.met = self.met[stays] // 2

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("incoming", rows)
        self.db.sql(f"CREATE TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def _query(self, sql: str, name: str, rows: pa.Table) -> pa.Table:
        self.db.register(name, rows)
        out = self.db.sql(sql).to_arrow_table()
        self.db.unregister(name)
        return out

    def _by_heap(self, word: bytes) -> list[int]:
        """The leftmost pair of least rank first, for very long words: a linked list of pieces and a heap with lazy deletion."""
        ranks, n = self.ranks, len(word)
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def pair(i: int) -> tuple[int, int, int] | None:
            """The rank of the piece at i with the next one, where they begin, and where they end."""
            if i < 0 or (j := ends[i]) >= n or (rank := ranks.get(word[i : ends[j]])) is None:
                return None
            return rank, i, ends[j]

        heap = [p for i in range(n - 1) if (p := pair(i))]
        heapq.heapify(heap)
        while heap:
            found = heapq.heappop(heap)
            i = found[1]
            if ends[i] <= i or pair(i) != found:
                continue
            j = ends[i]
            ends[i], ends[j] = ends[j], -1
            if ends[i] < n:
                before[ends[i]] = i
            for x in (before[i], i):
                if p := pair(x):
                    heapq.heappush(heap, p)
        return [ranks[word[i : ends[i]]] for i in range(n) if ends[i] > i]

    def parts(self, word: bytes) -> list[bytes]:
        """A word cut where no token can lie across, so that its parts are contracted apart."""
        raw = np.frombuffer(word, dtype=np.uint8).astype(np.int32)
        cut = np.flatnonzero(~self.inside[(raw[:-1] << 8) | raw[1:]]) + 1
        return [word[a:z] for a, z in zip([0, *cut.tolist()], [*cut.tolist(), len(word)], strict=True)]

    def contracted(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of words by queries, as many in one as its bounds allow."""
        got: list[np.ndarray] = []
        squares = np.cumsum([len(w) ** 2 for w in words], dtype=np.int64)
        while len(got) < len(words):
            at = len(got)
            upto = int(np.searchsorted(squares, (squares[at - 1] if at else 0) + SQUARES_A_QUERY, side="right"))
            part = words[at : max(at + 1, min(upto, at + WORDS_A_QUERY))]
            ends = np.cumsum([0, *map(len, part)], dtype=np.int32)
            toks = self.of_byte[np.frombuffer(b"".join(part), dtype=np.uint8)]
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(toks))
            out = self._query(ENCODE, "words", pa.table({"wid": np.arange(len(part), dtype=np.int32), "toks": lists}))["toks"].combine_chunks()
            flat, cut = out.values.to_numpy().astype("<u4"), out.offsets.to_numpy()
            got += [flat[a:z] for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        return got

    def learn(self, words: list[str]) -> None:
        """Appends the ids of new words to the memo."""
        got: list[np.ndarray] = [EMPTY] * len(words)
        rest: list[tuple[int, bytes]] = []
        long: dict[int, list[bytes]] = {}
        for k, w in enumerate(words):
            raw = w.encode()
            if (whole := self.ranks.get(raw)) is not None:
                got[k] = np.array([whole], dtype="<u4")
            elif len(raw) > LONG_WORD:
                long[k] = self.parts(raw)
            else:
                rest.append((k, raw))
        for (k, _), ids in zip(rest, self.contracted([raw for _, raw in rest]), strict=True):
            got[k] = ids
        # parts repeat, such as a script's single signs
        parts = list(dict.fromkeys(p for cut in long.values() for p in cut))
        known = {p: np.array([self.ranks[p]], dtype="<u4") if p in self.ranks else np.array(self._by_heap(p), dtype="<u4") for p in parts if p in self.ranks or len(p) > LONG_WORD}
        other = [p for p in parts if p not in known]
        known |= zip(other, self.contracted(other), strict=True)
        for k, cut in long.items():
            got[k] = np.concatenate([known[p] for p in cut])
        self.ids = np.concatenate([self.ids, *got])
        self.id_cut = np.concatenate([self.id_cut, self.id_cut[-1] + np.cumsum([len(g) for g in got], dtype=np.int64)])

    def decode_known(self) -> None:
        """Decodes the ids of those numbered words that have no bytes yet."""
        for at in range(len(self.raw_cut) - 1, len(self.id_cut) - 1, 4 * WORDS_A_QUERY):
            cut = self.id_cut[at : at + 4 * WORDS_A_QUERY + 1]
            raw = self._decoded(self.ids[cut[0] : cut[-1]], cut - cut[0])
            self.raw = np.concatenate([self.raw, np.frombuffer(b"".join(raw), dtype=np.uint8)])
            self.raw_cut = np.concatenate([self.raw_cut, self.raw_cut[-1] + np.cumsum([len(r) for r in raw])])

    def _decoded(self, ids: np.ndarray, cut: np.ndarray) -> list[bytes]:
        lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(ids.astype(np.int32)))
        got = self._query(DECODE, "seqs", pa.table({"sid": np.arange(len(cut) - 1, dtype=np.int32), "toks": lists}))
        out = [b""] * (len(cut) - 1)  # a sequence without ids has no row
        for k, piece in zip(got["sid"].to_pylist(), got["bytes"].to_pylist(), strict=True):
            out[k] = piece.encode("latin-1")
        return out

    def runs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The texts as numbered words, and where each text's words begin and end."""
        if len(self.index) > MEMO_WORDS:
            self.forget_rare()
        split = [self.split(t) for t in texts]
        ends = np.cumsum([0, *map(len, split)])
        words = np.fromiter(map(self.index.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=ends[-1])
        if self.index.new:
            new, self.index.new = self.index.new, []
            self.learn(new)
        self.met = np.concatenate([self.met, np.zeros(len(self.index) - len(self.met), dtype=np.int64)]) + np.bincount(words, minlength=len(self.index))
        return words, ends

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's ids begin and end."""
        return self.encode_runs(*self.runs(texts))

    def encode_runs(self, words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return stretches(self.ids, self.id_cut, words, ends)

    def decode_runs(self, words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that the words' ids stand for; each numbered word's ids are decoded once."""
        self.decode_known()
        return stretches(self.raw, self.raw_cut, words, ends)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The bytes that each sequence of ids stands for."""
        if len(ids) and (ids.max() >= len(self.known) or not self.known[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        return self._decoded(ids, ends)


class Numbers(dict):
    """Numbers words in the order in which they are first asked for, and lists the new ones."""

    def __init__(self, known: Iterable[tuple[str, int]] = ()):
        super().__init__(known)
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


def stretches(flat: np.ndarray, cut: np.ndarray, which: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbered stretches of a flat array, one after the other, and the ends of groups of them."""
    begin, size = cut[which], cut[which + 1] - cut[which]
    after = np.concatenate([[0], np.cumsum(size)])
    return flat[np.repeat(begin - after[:-1], size) + np.arange(after[-1])], after[ends]


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each vocabulary and Python worker; tasks that follow reuse it."""
    return Codec(path, pattern)


def steps(texts: list[str], chars: int = CHARS_A_STEP) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters each, so that memory does not follow the length of texts."""
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > chars:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)
    trim()


def _batches(batches: Iterator[pa.RecordBatch], path: str, pattern: str, lists: bool, digests: bool) -> Iterator[pa.RecordBatch]:
    c = codec(path, pattern)
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for at, end in steps(texts):
            words, ends = c.runs(texts[at:end])
            ids, cut = c.encode_runs(words, ends)
            out = {"doc_id": batch.column("doc_id").slice(at, end - at), "n_tokens": pa.array(np.diff(cut), pa.int64())}
            if lists:
                out["ids"] = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(ids.astype(np.int32)))
            if digests:
                out["ids_sha256"] = digested(ids, cut)
                out["decoded_sha256"] = digested(*c.decode_runs(words, ends))
            yield pa.RecordBatch.from_pydict(out)


def digested(flat: np.ndarray, cut: np.ndarray) -> pa.Array:
    return pa.array([hashlib.sha256(flat[a:b]).hexdigest() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.string())


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty("text").alias("text"))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (array of int) of every row; a null or empty text has no ids. Rows are kept as they are, repeated ones too, and other columns are dropped."""
    schema = T.StructType().add("doc_id", "long").add("n_tokens", "long").add("ids", T.ArrayType(T.IntegerType()))
    return _documents(docs).mapInArrow(lambda b: _batches(b, path, pattern, True, False), schema)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, bytes of every row with ids; null ids count as none. An id that the vocabulary lacks is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            ids = [np.array(x or [], dtype="<u4") for x in batch.column("ids").to_pylist()]
            raw = c.decode(np.concatenate([EMPTY, *ids]), np.cumsum([0, *map(len, ids)]))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "bytes": pa.array(raw, pa.binary())})

    return encoded.select("doc_id", "ids").mapInArrow(run, T.StructType().add("doc_id", "long").add("bytes", "binary"))


def encode_and_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: the ids are decoded again, and both sides are digested.

    A null text counts as empty (no ids, the digests of nothing); repeated rows and null doc_ids each give a row of their own; an empty
    table gives no row. There is no shuffle.
    """
    schema = T.StructType().add("doc_id", "long").add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    return _documents(docs).mapInArrow(lambda b: _batches(b, path, pattern, False, True), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_and_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
