"""Approximate nearest neighbours by a hierarchical navigable small-world graph for each shard.

A coarse quantiser, fitted on a bounded sample, deals every vector into a cell; cells that would hold more than SHARD vectors are split by
hash into several shards. A shard's graph has levels drawn as for insertion; on each level a point is linked with its nearest points there,
diversified and made mutual, and stored as flat neighbour arrays. A query visits the cells nearest to it, as many as the sample says that
nearly all neighbours lie in; what their shards find is scored in double precision on the original vectors and merged.

Equal vectors are one point that carries the smallest ids of its rows, as many as an answer can need.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

#: A shard has about so many points at most, a cell about so many while there are fewer than MOST_CELLS of them.
SHARD, CELL, MOST_CELLS = 16_384, 8_192, 4_096
#: The quantiser is fitted on at most so many vectors, those with the least hash.
SAMPLE_ROWS, SAMPLE_QUERIES, COVERED = 32_768, 400, 0.985
BLOCK, STEP = 2_048, 256
LINKS, NEAR, SEARCH_WIDTH, EXPAND = 16, 48, 160, 4
NEAREST, EVERY = 5, 50

INDEX = "dim int, shard int, points binary, levels binary, links binary, upper binary, ids array<array<long>>"


def nearest_of(points: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """For each query the places of its k nearest points (unit vectors), nearest first; a block of queries at a time."""
    out = np.empty((len(queries), min(k, len(points))), dtype=np.int64)
    for at in range(0, len(queries), 1024):
        near = queries[at : at + 1024] @ points.T
        few = np.argpartition(-near, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
        out[at : at + 1024] = np.take_along_axis(few, np.argsort(-np.take_along_axis(near, few, axis=1), axis=1, kind="stable"), axis=1)
    return out


def diverse(unit: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Of each row's points, nearest first and -1 at the end, the first most that are nearer to the row's own point than to any chosen before, then the nearest left, -1 where there are none."""
    out = np.full((len(near), most), -1, dtype=np.int32)
    for at in range(0, len(near), STEP):
        rows = near[at : at + STEP]
        there = rows >= 0
        points = unit[rows]
        own = np.where(there, (points @ unit[np.arange(at, at + len(rows)), :, None])[:, :, 0], -np.inf)
        among = points @ points.transpose(0, 2, 1)
        closest = np.full(rows.shape, -np.inf, dtype=among.dtype)
        chosen, count = np.zeros(rows.shape, dtype=bool), np.zeros(len(rows), dtype=int)
        for k in range(rows.shape[1]):
            take = there[:, k] & (count < most) & (closest[:, k] < own[:, k])
            chosen[:, k] = take
            count += take
            closest = np.where(take[:, None], np.maximum(closest, among[:, k]), closest)
        order = np.argsort(~chosen * 2 + ~there * 4, axis=1, kind="stable")[:, :most]
        out[at : at + STEP, : order.shape[1]] = np.take_along_axis(rows, order, axis=1)
    return out


def linked(unit: np.ndarray, links: int, width: int) -> np.ndarray:
    """A level's neighbours: links diverse ones of each point, those that chose it, the nearest first up to width in all, and links that join parts which would be apart."""
    n = len(unit)
    if n <= width:
        table = np.full((n, width), -1, dtype=np.int32)
        if n > 1:
            table[:, : n - 1] = np.stack([np.delete(np.arange(n), i) for i in range(n)])
        return table
    near = nearest_of(unit, unit, NEAR + 1)
    own = near == np.arange(n)[:, None]
    own[~own.any(axis=1), -1] = True
    forward = diverse(unit, near[~own].reshape(n, -1), links)
    a, b = np.repeat(np.arange(n), links), forward.ravel()
    a, b = np.concatenate([a, b])[np.tile(b >= 0, 2)], np.concatenate([b, a])[np.tile(b >= 0, 2)]
    a, b = np.unique(np.stack([a, b], axis=1), axis=0).T
    score = np.concatenate([(unit[a[k : k + 65536]] * unit[b[k : k + 65536]]).sum(axis=1) for k in range(0, len(a), 65536)])
    order = np.lexsort((-score, a))
    a, b = a[order], b[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    table = np.full((n, width), -1, dtype=np.int32)
    fit = place < width
    table[a[fit], place[fit]] = b[fit]
    part = parts(table)
    main = np.bincount(part).argmax()
    for p in np.unique(part[part != main]).tolist():
        mine, rest = np.flatnonzero(part == p), np.flatnonzero(part == main)
        x = mine[0]
        y = rest[np.argmax(unit[rest] @ unit[x])]
        table[x, -1], table[y, -1] = y, x
    return table


def parts(table: np.ndarray) -> np.ndarray:
    """The least point that can be reached from each, by links in either direction."""
    label = np.arange(len(table))
    a, b = np.repeat(label, table.shape[1]), table.ravel()
    a, b = a[b >= 0], b[b >= 0]
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


class Graph:
    """Unit vectors with, on each level, a flat array of neighbours (-1 where there is none): 2 * links of them on level 0, links above."""

    def __init__(self, unit: np.ndarray, levels: np.ndarray, tables: list[np.ndarray]):
        self.unit, self.levels, self.tables = unit, levels, tables
        self.start = int(np.argmax(levels)) if len(levels) else -1

    @staticmethod
    def build(unit: np.ndarray, links: int = LINKS, seed: int = 7) -> Graph:
        levels = np.minimum((-np.log(1 - np.random.default_rng(seed).random(len(unit))) / np.log(links)).astype(np.int64), 12)
        tables = []
        for k in range(int(levels.max(initial=0)) + 1):
            here = np.flatnonzero(levels >= k)
            own = linked(unit[here], links if k == 0 else links // 2, 2 * links if k == 0 else links)
            table = np.full((len(unit), own.shape[1]), -1, dtype=np.int32)
            table[here] = np.where(own >= 0, here[own], -1)
            tables.append(table)
        return Graph(unit, levels, tables)

    def search(self, queries: np.ndarray, width: int = SEARCH_WIDTH) -> np.ndarray:
        """For each query the places of the width points found, nearest first, -1 where there are fewer. All queries of a step walk together."""
        width = min(width, max(len(self.unit), 1))
        out = np.full((len(queries), width), -1, dtype=np.int64)
        if self.start >= 0:
            for at in range(0, len(queries), STEP):
                out[at : at + STEP] = self._walk(queries[at : at + STEP], width)
        return out

    def _walk(self, q: np.ndarray, width: int) -> np.ndarray:
        unit, n = self.unit, len(q)
        rows = np.arange(n)
        near = lambda places: (unit[places] @ q[: len(places), :, None])[:, :, 0]
        here = np.full(n, self.start)
        best = near(here[:, None])[:, 0]
        for table in self.tables[:0:-1]:
            while True:
                others = table[here]
                score = np.where(others >= 0, near(others), -np.inf)
                k = score.argmax(axis=1)
                better = score[rows, k] > best
                if not better.any():
                    break
                here, best = np.where(better, others[rows, k], here), np.where(better, score[rows, k], best)
        seen = np.zeros((n, len(unit) + 1), dtype=bool)
        seen[rows, here] = seen[:, -1] = True
        places, scores, done = np.full((n, width), -1), np.full((n, width), -np.inf, dtype=best.dtype), np.ones((n, width), dtype=bool)
        places[:, 0], scores[:, 0], done[:, 0] = here, best, False
        while not done.all():
            # beams are sorted: the first open places are the best ones
            open_ = np.argsort(done, axis=1, kind="stable")[:, :EXPAND]
            from_ = np.where(np.take_along_axis(done, open_, axis=1), -1, np.take_along_axis(places, open_, axis=1))
            np.put_along_axis(done, open_, True, axis=1)
            new = np.where(from_[:, :, None] >= 0, self.tables[0][from_], -1).reshape(n, -1)
            new = np.sort(new, axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            new[seen[rows[:, None], new]] = -1
            seen[rows[:, None], new] = True
            score = np.where(new >= 0, near(new), -np.inf)
            every, of = np.concatenate([scores, score], axis=1), np.concatenate([places, new], axis=1)
            order = np.argsort(-every, axis=1, kind="stable")[:, :width]
            done = np.take_along_axis(np.concatenate([done, new < 0], axis=1), order, axis=1)
            places, scores = np.take_along_axis(of, order, axis=1), np.take_along_axis(every, order, axis=1)
        return places

    def packed(self) -> tuple[bytes, bytes, bytes]:
        """Levels, neighbours on level 0, and those above: for each level, rows of the points that reach it."""
        above = [t[self.levels >= k].ravel() for k, t in enumerate(self.tables) if k]
        return self.levels.astype("<i4").tobytes(), self.tables[0].astype("<i4").tobytes(), np.concatenate([np.zeros(0, np.int32), *above]).astype("<i4").tobytes()

    @staticmethod
    def unpacked(unit: np.ndarray, levels: bytes, links: bytes, upper: bytes) -> Graph:
        of, n = np.frombuffer(levels, "<i4"), len(unit)
        flat, tables, at = np.frombuffer(upper, "<i4"), [np.frombuffer(links, "<i4").reshape(n, -1)], 0
        width = tables[0].shape[1] // 2
        for k in range(1, int(of.max(initial=0)) + 1):
            here = of >= k
            table = np.full((n, width), -1, dtype=np.int32)
            table[here] = flat[at : at + here.sum() * width].reshape(-1, width)
            at += int(here.sum()) * width
            tables.append(table)
        return Graph(unit, of, tables)


class Quantiser:
    """Centres of cells, into how many shards each cell is split, and how many cells a query visits."""

    def __init__(self, sample: np.ndarray, rows: int, nearest: int):
        """sample: unit vectors. rows: how many vectors there are in all."""
        n = max(1, min(MOST_CELLS, -(-rows // CELL), len(sample)))
        rng = np.random.default_rng(11)
        self.centres = sample[np.sort(rng.choice(len(sample), n, replace=False))] if len(sample) else np.zeros((1, 1))
        for _ in range(8 if n > 1 else 0):
            cell = self.cells(sample, 1)[:, 0]
            sums = np.zeros_like(self.centres)
            np.add.at(sums, cell, sample)
            size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
            self.centres = np.where(size > 0, sums / np.maximum(size, 1e-30), self.centres)
        cell = self.cells(sample, 1)[:, 0] if len(sample) else np.zeros(0, np.int64)
        share = np.bincount(cell, minlength=n) / max(len(sample), 1)
        self.split = np.maximum(1, np.ceil(share * rows / SHARD)).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.split)])
        self.visits = n
        if n > 1 and len(sample) > nearest:
            asked = np.arange(0, len(sample), max(1, len(sample) // SAMPLE_QUERIES))
            near = nearest_of(sample, sample[asked], nearest + 1)[:, 1:]
            order = self.cells(sample[asked], n)
            rank = np.empty_like(order)
            np.put_along_axis(rank, order, np.broadcast_to(np.arange(n), order.shape), axis=1)
            need = np.take_along_axis(rank, cell[near], axis=1).ravel()
            self.visits = int(np.quantile(need, COVERED, method="higher")) + 1

    def cells(self, unit: np.ndarray, k: int) -> np.ndarray:
        """The k cells nearest to each vector, nearest first."""
        return nearest_of(self.centres, unit, k)


def scaled(points: np.ndarray) -> np.ndarray:
    """Rows divided by their largest component, so that squares neither overflow nor vanish; the cosine stays."""
    return points / np.abs(points).max(axis=1, keepdims=True)


def units(points: np.ndarray) -> np.ndarray:
    z = scaled(points)
    return z / np.sqrt((z * z).sum(axis=1, keepdims=True))


def cosines(points: np.ndarray, q: np.ndarray) -> np.ndarray:
    z, y = scaled(points), scaled(q[None])[0]
    return (z * y).sum(axis=1) / (np.sqrt((z * z).sum(axis=1)) * np.sqrt((y * y).sum()))


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components, and not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _by_dim(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """The rows of a batch by their vectors' length."""
    for batch in batches:
        dims = batch.column("dim").to_numpy(zero_copy_only=False)
        for dim in np.unique(dims).tolist():
            rows = batch.take(pa.array(np.flatnonzero(dims == dim)))
            yield dim, rows, _vectors(rows.column("vector"), dim)


def _shards(unit: np.ndarray, q: Quantiser) -> np.ndarray:
    """Each vector's shard: its nearest cell's, by a hash of the vector where the cell has several."""
    cell = q.cells(unit, 1)[:, 0]
    salt = (np.abs(unit).sum(axis=1) * 1e6).astype(np.int64)
    return q.first[cell] + salt % q.split[cell]


def _dealt(batches: Iterator[pa.RecordBatch], quantisers: dict[int, Quantiser], nearest: int) -> Iterator[pa.RecordBatch]:
    """dim, shard, vector and the smallest ids of the batch's rows with that vector: a vector that many rows share is sent once a batch."""
    for dim, rows, points in _by_dim(batches):
        one, of = np.unique(points, axis=0, return_inverse=True)
        ids = rows.column("vec_id").to_numpy(zero_copy_only=False)
        order = np.lexsort((ids, of.ravel()))
        cut = np.concatenate([[0], np.cumsum(np.bincount(of.ravel(), minlength=len(one)))])
        yield pa.RecordBatch.from_pydict({
            "dim": pa.array(np.full(len(one), dim), pa.int32()), "shard": pa.array(_shards(units(one), quantisers[dim]), pa.int32()),
            "vector": pa.array([x.tobytes() for x in one], pa.binary()), "ids": pa.array([np.unique(ids[order[a:b]])[: nearest + 1] for a, b in zip(cut, cut[1:], strict=False)], pa.list_(pa.int64())),
        })


def _routed(batches: Iterator[pa.RecordBatch], quantisers: dict[int, Quantiser]) -> Iterator[pa.RecordBatch]:
    """A row for each shard that a query visits. Queries with lengths that no vector has visit none."""
    for dim, rows, points in _by_dim(batches):
        q = quantisers.get(dim)
        if q is None:
            continue
        cell = q.cells(units(points), q.visits)
        count = q.split[cell].ravel()
        of = np.repeat(np.arange(len(points)).repeat(cell.shape[1]), count)
        shard = np.repeat(q.first[cell].ravel(), count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        yield pa.RecordBatch.from_pydict({
            "query_id": rows.column("vec_id").take(pa.array(of)), "dim": pa.array(np.full(len(of), dim), pa.int32()), "shard": pa.array(shard, pa.int32()),
            "vector": pa.array([points[k].tobytes() for k in of.tolist()], pa.binary()),
        })


def _built(rows: pa.Table, nearest: int) -> pa.Table:
    dim, known = rows["dim"][0].as_py(), {}
    for vector, ids in zip(rows["vector"].to_pylist(), rows["ids"].to_pylist(), strict=True):
        known.setdefault(vector, []).append(ids)
    vectors = sorted(known)
    points = np.frombuffer(b"".join(vectors), np.float64).reshape(-1, dim)
    ids = [sorted({i for some in known[v] for i in some})[: nearest + 1] for v in vectors]
    levels, links, upper = Graph.build(units(points).astype(np.float32)).packed()
    return pa.table({
        "dim": pa.array([dim], pa.int32()), "shard": rows["shard"][:1].combine_chunks(), "points": pa.array([points.tobytes()], pa.binary()),
        "levels": pa.array([levels], pa.binary()), "links": pa.array([links], pa.binary()), "upper": pa.array([upper], pa.binary()), "ids": pa.array([ids], pa.list_(pa.list_(pa.int64()))),
    })


def fitted(vectors: DataFrame, nearest: int) -> dict[int, Quantiser]:
    """A quantiser for each length of vectors, fitted on at most SAMPLE_ROWS vectors of all lengths, those with the least hash. Lengths that the sample lacks have one cell."""
    sizes = {r["dim"]: r["n"] for r in vectors.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    some = vectors.select("dim", "vector").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).toArrow()
    dims, out = some["dim"].to_numpy(), {}
    for dim, n in sizes.items():
        own = some["vector"].filter(pa.array(dims == dim)).combine_chunks()
        points = np.unique(_vectors(own, dim), axis=0) if len(own) else np.zeros((0, dim))
        out[dim] = Quantiser(units(points), n, nearest) if len(points) else Quantiser(np.ones((1, dim)), n, nearest)
    return out


def build_index(vectors: DataFrame, quantisers: dict[int, Quantiser], nearest: int, scratch: Scratch) -> DataFrame:
    """The shards' graphs in a table. vectors: vec_id, vector (array of double), dim, all usable. Vectors shuffle once."""
    dealt = vectors.mapInArrow(lambda b: _dealt(b, quantisers, nearest), "dim int, shard int, vector binary, ids array<long>")
    # a task a shard: building is heavy, and small shuffles would be merged into few tasks
    shards = sum(int(q.first[-1]) for q in quantisers.values())
    return scratch.stored(dealt.repartition(max(1, shards), "dim", "shard").groupBy("dim", "shard").applyInArrow(lambda t: _built(t, nearest), INDEX), "ann-index")


def search(vectors: DataFrame, queries: DataFrame, nearest: int = NEAREST) -> DataFrame:
    """A row for each query and rank: query_id, rank (from 1), vec_id, score (cosine in double precision), nearest first, ties to the smaller vec_id.

    vectors and queries: vec_id and embedding. Candidates of a query are all rows with another vec_id and as many components. Rows with
    a null vec_id, and vectors that are null, all zero, or hold null or non-finite components take no part. Rows that repeat a vec_id and
    vector count once; where a vec_id has several vectors its best score counts. Fewer candidates give fewer ranks, an empty table none.
    Other columns are dropped.
    """
    scratch = Scratch(vectors.sparkSession)
    vector = F.col("embedding").cast("array<double>")
    take = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"), F.size(vector).alias("dim")).filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    quantisers = fitted(take(vectors), nearest)
    index = build_index(take(vectors), quantisers, nearest, scratch)
    asked = scratch.stored(take(queries).mapInArrow(lambda b: _routed(b, quantisers), "query_id long, dim int, shard int, vector binary"), "ann-queries")
    keys = ("dim", "shard", "block")
    blocks = scratch.stored(asked.groupBy("dim", "shard").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "ann-blocks")
    here = index.join(blocks, ["dim", "shard"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    each = asked.join(blocks, ["dim", "shard"]).withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).select("query_id", "vector", *(F.col(k).alias(f"to_{k}") for k in keys))

    def find(graphs: pa.Table, asking: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = [], [], []
        if graphs.num_rows and asking.num_rows:
            g = graphs.to_pylist()[0]
            points = np.frombuffer(g["points"], np.float64).reshape(-1, g["dim"])
            graph = Graph.unpacked(units(points).astype(np.float32), g["levels"], g["links"], g["upper"])
            asks = np.frombuffer(b"".join(asking["vector"].to_pylist()), np.float64).reshape(-1, g["dim"])
            found = graph.search(units(asks).astype(np.float32))[:, : 4 * nearest + 4]
            for query_id, q, places in zip(asking["query_id"].to_pylist(), asks, found, strict=True):
                places = places[places >= 0]
                score = cosines(points[places], q)
                rows = [(-s, v) for k, s in zip(places.tolist(), score.tolist(), strict=True) for v in g["ids"][k] if v != query_id]
                for s, v in heapq.nsmallest(2 * nearest, rows):
                    out[0].append(query_id)
                    out[1].append(v)
                    out[2].append(-s)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    found = here.groupBy(*keys).cogroup(each.groupBy(*(f"to_{k}" for k in keys))).applyInArrow(find, "query_id long, vec_id long, score double")
    best = scratch.stored(found, "ann-found").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    scratch.drop(index, asked, blocks)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))
