"""Exact dedup by two-pass Bloom filtering: only rows whose text may be repeated shuffle, the others pass straight through.

Tasks send the hashes of their own distinct texts (8 bytes each, twice if they have seen a text twice), never rows, dealt into segments of
about SEGMENT_ROWS. Pass one over a segment's hashes counts, up to two, in the cells of a Bloom filter of the segment's own size; pass two
probes the same hashes and returns those whose cells all count two: a repeated hash always does, one in some thousands of the others too.
There are as many segments as the rows need, so that the filter works the same at every size. A row with such a hash costs a shuffle, no
more, as groups are then made by SHA-256.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fold_ascii, fresh, join_hot, small_enough, text_or_empty

SEGMENT_ROWS = 1 << 16
CELLS_A_ROW, PROBES = 16, 3
#: Possibly repeated hashes of 8 bytes are broadcast up to this number; more of them meet the rows in a join, where those of many rows are salted.
BROADCAST_HASHES = 2_000_000


def normalised(name: str = "text") -> Column:
    """The text with A-Z lower-cased; null counts as empty."""
    return fold_ascii(text_or_empty(name))


def _send(batches: Iterator[pa.RecordBatch], segments: int) -> Iterator[pa.RecordBatch]:
    """Each hash of a batch once, or twice if the batch has it twice, packed by segment."""
    for batch in batches:
        seen, n = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_counts=True)
        if not len(seen):
            continue
        seen = np.concatenate([seen, seen[n > 1]])
        segment = (seen.view(np.uint64) % np.uint64(segments)).astype(np.int32)
        order = np.argsort(segment, kind="stable")
        segment, seen = segment[order], seen[order]
        starts = np.concatenate([[0], np.flatnonzero(np.diff(segment)) + 1, [len(seen)]])
        yield pa.RecordBatch.from_pydict({
            "segment": pa.array(segment[starts[:-1]], pa.int32()),
            "hashes": pa.array([seen[a:b].astype("<i8").tobytes() for a, b in zip(starts, starts[1:], strict=False)], pa.binary()),
        })


def twice(hashes: np.ndarray) -> np.ndarray:
    """The hashes that may be in the array twice or more: all that are, and few others."""
    cells = 1 << max(6, (len(hashes) * CELLS_A_ROW - 1).bit_length())
    count = np.zeros(cells, dtype=np.int64)
    mixed = hashes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    # probes share the cells: one hash's own probes may meet in a cell, which makes a hash too many and none too few
    probes = [((mixed ^ (mixed >> np.uint64(29 + 3 * k))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * k) >> np.uint64(64 - (cells.bit_length() - 1))).astype(np.int64) for k in range(PROBES)]
    for at in probes:
        count += np.minimum(np.bincount(at, minlength=cells), 2)
    hit = np.ones(len(hashes), dtype=bool)
    for at in probes:
        hit &= count[at] >= 2
    return hashes[hit]


def _twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by segment: holds one segment's hashes and filter at a time."""
    held: list[bytes] = []
    now = None

    def flush() -> pa.RecordBatch:
        h, n = np.unique(twice(np.frombuffer(b"".join(held), dtype="<i8")), return_counts=True)
        return pa.RecordBatch.from_pydict({"h": pa.array(h, pa.int64()), "sent": pa.array(n, pa.int64())})

    for batch in batches:
        for segment, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if segment != now and held:
                yield flush()
                held = []
            now = segment
            held.append(raw)
    if held:
        yield flush()


def repeated_hashes(hashes: DataFrame, rows: int, scratch: Scratch) -> DataFrame:
    """h, sent: the hashes of the only column that may occur twice, and how often tasks have sent them."""
    segments = max(1, -(-rows // SEGMENT_ROWS))
    sent = hashes.mapInArrow(lambda b: _send(b, segments), "segment int, hashes binary")
    return scratch.stored(sent.repartition("segment").sortWithinPartitions("segment").mapInArrow(_twice, "h long, sent long"), "repeated-hashes")


def _met(rows: DataFrame, h: str, found: DataFrame, maybe: str) -> DataFrame:
    """The rows with whether their hash may be repeated. No row shuffles while few hashes are."""
    hashes = found.select(F.col("h").alias(h), F.lit(True).alias(maybe), F.col("sent").alias(f"{maybe}_sent"))
    if small_enough(found, BROADCAST_HASHES):
        out = rows.join(F.broadcast(hashes.drop(f"{maybe}_sent")), h, "left")
    else:
        out = join_hot(rows, hashes, h, f"{maybe}_sent", F.monotonically_increasing_id(), "left").drop(f"{maybe}_sent")
    return out.withColumn(maybe, F.coalesce(maybe, F.lit(False)))


def groups(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts (A-Z lower-cased, null as empty) the row with the largest doc_id stays, a null doc_id counting as the least; of
    repeated rows with that doc_id one stays. Empty texts are equal to each other. Other columns are dropped; an empty table gives no row.
    Groups are counted with partial sums in each task and joined back by digest, the rows of large groups by salts.
    """
    scratch, text = Scratch(docs.sparkSession), normalised()
    rows = docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("sha"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("row"))
    rows = scratch.stored(rows, "dedup-rows")
    found = repeated_hashes(rows.select("h"), rows.count(), scratch)
    marked = _met(rows, "h", found, "maybe")
    maybe = marked.filter("maybe").drop("maybe", "h")
    best = scratch.stored(maybe.groupBy("sha").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("n")), "dedup-groups")
    met = join_hot(maybe, best, "sha", "n", F.col("row"))
    digest = F.lower(F.hex("sha")).alias("text_sha256")
    alone = marked.filter(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), digest)
    return alone.unionByName(met.select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("best.row")).alias("kept"), digest))


def dedup(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their columns: rows that cannot be repeated pass straight through, the others meet by digest.

    Of a group the row with the largest doc_id stays; of several such rows the one with the greatest text by code point, then the greatest hash of
    its columns, so that runs agree. Each task keeps the best row of each of its groups before any row is sent.
    """
    scratch, text = Scratch(docs.sparkSession), normalised()
    h, maybe, sha, best = fresh([*docs.columns, "h", "sent"], "hash", "maybe", "sha", "best")
    found = repeated_hashes(docs.select(F.xxhash64(text).alias("h")), docs.count(), scratch)
    rows = _met(docs.withColumn(h, F.xxhash64(text)), h, found, maybe)
    hashable = [F.col(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString()]
    order = F.struct("doc_id", "text", F.xxhash64(*hashable))
    again = rows.filter(F.col(maybe)).withColumn(sha, F.sha2(text, 256)).groupBy(sha).agg(F.max_by(F.struct(*docs.columns), order).alias(best))
    return rows.filter(~F.col(maybe)).select(*docs.columns).unionByName(again.select(*(F.col(best).getField(c).alias(c) for c in docs.columns)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
WITH folded AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM folded
"""
