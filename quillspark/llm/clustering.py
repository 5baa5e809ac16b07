"""Centroid clustering by dual-tree Lloyd rounds, in whole numbers.

Vectors lie in blocks; every block has a cover tree, made once and stored with it. In each round the centroids get a tree of their own, and a
task walks pairs of a vector node and a centroid node from both roots: a pair goes when no vector of the one can have its nearest centroid
in the other. A node with one centroid left gives its vectors' sum at once; leaves that keep several are compared exactly. Tasks send sums by
centroid, never vectors, so that a round moves a row for each centroid and component from each task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

SIZE, CENTROIDS, ROUNDS, SEED, SCALE = 64, 16, 3, 1, 64
#: Whole components are held to this, as squared distances would not fit 64 bits beyond.
LARGEST = 1 << 27
BLOCK, LEAF, PAIRS = 1_024, 8, 8_192


@dataclass
class Tree:
    """Nodes in levels, the root first: the place of a node's centre, the stretch of places under it, its children's numbers (none of a leaf), and how far its furthest point is from the centre."""

    centre: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray
    last: np.ndarray
    radius: np.ndarray

    FIELDS = (("centre", "<i4"), ("begin", "<i4"), ("end", "<i4"), ("first", "<i4"), ("last", "<i4"), ("radius", "<f8"))

    def packed(self) -> dict[str, bytes]:
        return {name: getattr(self, name).astype(kind).tobytes() for name, kind in self.FIELDS}

    @classmethod
    def unpacked(cls, row: dict) -> Tree:
        return cls(**{name: np.frombuffer(row[name], kind) for name, kind in cls.FIELDS})


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows (64-bit integers)."""
    d = a - b
    return np.einsum("...i,...i->...", d, d)


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, Tree]:
    """The points' order in the tree, and the tree. A node's points lie within its radius of its centre, children take points within half
    of it, and the children's centres, of which the first is the node's own, are more than that apart. Nodes of few or only equal points are leaves."""
    order = np.arange(len(points))
    centre, begin, end, first, last, radius = [0], [0], [len(points)], [0], [0], [0.0]
    far = {0: np.sqrt(squared(points, points[0]).astype(np.float64))}
    node = 0
    while node < len(centre):
        a, z, dist = begin[node], end[node], far.pop(node)
        radius[node] = float(dist.max()) if len(dist) else 0.0
        if z - a > leaf and radius[node] > 0:
            half, rest, parts = radius[node] / 2, order[a:z].copy(), []
            while len(rest):
                near = dist <= half
                near[0] = True
                parts.append((rest[near], dist[near]))
                rest = rest[~near]
                if len(rest):
                    dist = np.sqrt(squared(points[rest], points[rest[0]]).astype(np.float64))
            first[node], last[node] = len(centre), len(centre) + len(parts)
            for own, own_dist in parts:
                order[a : a + len(own)] = own
                far[len(centre)] = own_dist
                centre.append(a)
                begin.append(a)
                end.append(a + len(own))
                first.append(0)
                last.append(0)
                radius.append(0.0)
                a += len(own)
        node += 1
    return order, Tree(*(np.array(x) for x in (centre, begin, end, first, last, radius)))


def expanded(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For stretches the number of each one's row, repeated, and the places in them."""
    size = end - begin
    row = np.repeat(np.arange(len(begin)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + begin[row]


def walk(points: np.ndarray, tree: Tree, centroids: np.ndarray, of: np.ndarray, tops: Tree) -> tuple[list[tuple[np.ndarray, np.ndarray]], tuple[np.ndarray, np.ndarray]]:
    """Stretches of vector nodes that have one centroid left, as (nodes, centroids), and the pairs of leaves and centroids that are to be compared.

    points and centroids are in their trees' order, of gives a centroid's number. All pairs of a vector node are opened together, so that
    its centroids left are those of its pairs. Bounds are held with a margin that is wider than rounding.
    """
    least = np.minimum.reduceat(of, tops.begin) if (tops.end - tops.begin == 1).all() else np.array([of[a:z].min() for a, z in zip(tops.begin, tops.end, strict=True)])
    is_leaf, is_top = tree.last == 0, tops.last == 0
    bound = np.full(len(tree.centre), np.inf)
    a, c = np.zeros(1, np.int64), np.zeros(1, np.int64)
    owned: list[tuple[np.ndarray, np.ndarray]] = []
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(a):
        dist = np.concatenate([np.sqrt(squared(points[tree.centre[a[k : k + PAIRS]]], centroids[tops.centre[c[k : k + PAIRS]]]).astype(np.float64)) for k in range(0, len(a), PAIRS)])
        np.minimum.at(bound, a, dist + tree.radius[a])
        keep = dist - tree.radius[a] - tops.radius[c] <= bound[a] * (1 + 1e-9) + 1e-6
        a, c = a[keep], c[keep]
        group = np.concatenate([[0], np.flatnonzero(np.diff(a)) + 1])
        size = np.diff(np.concatenate([group, [len(a)]]))
        single = np.repeat((size == 1) & is_top[c[group]], size)
        if single.any():
            owned.append((a[single], least[c[single]]))
            a, c = a[~single], c[~single]
            if not len(a):
                break
            group = np.concatenate([[0], np.flatnonzero(np.diff(a)) + 1])
            size = np.diff(np.concatenate([group, [len(a)]]))
        wide = ~is_top[c] & ((tops.radius[c] > tree.radius[a]) | is_leaf[a])
        open_c = np.repeat(np.logical_or.reduceat(wide, group), size)
        ready = is_leaf[a] & ~open_c
        done.append((a[ready], least[c[ready]]))
        a, c, open_c = a[~ready], c[~ready], open_c[~ready]
        if not len(a):
            break
        # either all centroid nodes of a vector node are opened, or the vector node is
        low = np.where(open_c, np.where(is_top[c], c, tops.first[c]), tree.first[a])
        high = np.where(open_c, np.where(is_top[c], c + 1, tops.last[c]), tree.last[a])
        row, child = expanded(low, high)
        new_a, new_c = np.where(open_c[row], a[row], child), np.where(open_c[row], child, c[row])
        np.minimum.at(bound, new_a, bound[a[row]])
        at = np.lexsort((new_c, new_a))
        a, c = new_a[at], new_c[at]
    none = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    return owned or none, tuple(map(np.concatenate, zip(*(done or none), strict=True)))


def compared(points: np.ndarray, tree: Tree, a: np.ndarray, k: np.ndarray, by_number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places under leaves a with the nearest of the centroids k that each leaf is paired with; of equal distances the smaller number. About PAIRS points are compared at a time."""
    best, cluster = np.full(len(points), -1, dtype=np.int64), np.full(len(points), -1, dtype=np.int64)
    order = np.lexsort((k, a))
    a, k = a[order], k[order]
    ends, at = np.cumsum(tree.end[a] - tree.begin[a]), 0
    while at < len(a):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        row, place = expanded(tree.begin[a[at:upto]], tree.end[a[at:upto]])
        number = k[at:upto][row]
        dist = squared(points[place], by_number[number])
        first = np.lexsort((number, dist, place))
        one = first[np.concatenate([[True], np.diff(place[first]) > 0])]
        # a leaf whose pairs are cut by a step's end meets its larger numbers later
        one = one[(best[place[one]] < 0) | (dist[one] < best[place[one]])]
        best[place[one]], cluster[place[one]] = dist[one], number[one]
        at = upto
    place = np.flatnonzero(cluster >= 0)
    return place, cluster[place]


def nearest(points: np.ndarray, tree: Tree, by_number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each point's nearest centroid (of equal distances the smaller number), and the squared distance."""
    of, tops = cover_tree(by_number, 1)
    owned, (a, k) = walk(points, tree, by_number[of], of, tops)
    cluster = np.zeros(len(points), dtype=np.int64)
    for nodes, numbers in owned:
        row, place = expanded(tree.begin[nodes], tree.end[nodes])
        cluster[place] = numbers[row]
    place, number = compared(points, tree, a, k, by_number)
    cluster[place] = number
    return cluster, squared(points, by_number[cluster])


BLOCKS = "ids array<long>, points binary, " + ", ".join(f"{name} binary" for name, _ in Tree.FIELDS)


def _blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), block):
            part = batch.slice(at, block)
            points = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(part), -1)
            order, tree = cover_tree(points)
            yield pa.RecordBatch.from_pydict({
                "ids": pa.array([part.column("vec_id").take(pa.array(order)).to_pylist()], pa.list_(pa.int64())), "points": pa.array([points[order].astype("<i4").tobytes()], pa.binary()),
                **{k: pa.array([v], pa.binary()) for k, v in tree.packed().items()},
            })


def _each(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[dict, np.ndarray, Tree]]:
    for batch in batches:
        for i in range(len(batch)):
            row = batch.slice(i, 1).to_pylist()[0]
            yield row, np.frombuffer(row["points"], "<i4").astype(np.int64).reshape(-1, size), Tree.unpacked(row)


def whole(embeddings: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """vec_id and v, whole components, of the vectors of that size without a null or non-finite component."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = embeddings.filter(F.coalesce((F.size("embedding") == size) & finite, F.lit(False)))
    number = lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int")
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", number).alias("v"))


def cluster(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part.

    A vector takes part if it has size components, none null or not finite; each becomes floor(scale * x), held to LARGEST either way. The
    first centroids are the k vectors with the least sha256 of '<seed>:<vec_id>' (a null vec_id as 'null'; of repeated vec_ids those with
    the least components first). A round gives each vector to the nearest centroid, the one of smaller number where several are, and moves
    every centroid that has vectors to the floor of their mean; at the end vectors are given once more. With fewer vectors than k there are
    fewer centroids, and without any no row. Repeated rows count each; other columns are dropped. A sum of distances beyond 64 bits is null.

    The driver holds the k centroids and their sums, nothing that grows with the vectors.
    """
    spark, scratch = embeddings.sparkSession, Scratch(embeddings.sparkSession)
    vectors = whole(embeddings, size, scale)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    blocks = scratch.stored(vectors.mapInArrow(lambda b: _blocks(b, BLOCK), BLOCKS), "vector-trees")
    centroids = np.array([r["v"] for r in vectors.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()], dtype=np.int64).reshape(-1, size)

    def sums(batches: Iterator[pa.RecordBatch], now: np.ndarray) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(now), np.int64), np.zeros(now.shape, np.int64)
        of, tops = cover_tree(now, 1)
        for _, points, tree in _each(batches, size):
            before = np.concatenate([np.zeros((1, size), np.int64), np.cumsum(points, axis=0)])
            owned, (a, numbers) = walk(points, tree, now[of], of, tops)
            place, own = compared(points, tree, a, numbers, now)
            np.add.at(n, own, 1)
            np.add.at(total, own, points[place])
            for nodes, numbers in owned:
                np.add.at(n, numbers, (tree.end - tree.begin)[nodes])
                np.add.at(total, numbers, before[tree.end[nodes]] - before[tree.begin[nodes]])
        number, at = np.divmod(np.arange(now.size), size)
        used = n[number] > 0
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(number[used], pa.int32()), "at": pa.array(at[used], pa.int32()), "n": pa.array(n[number[used]]), "total": pa.array(total.ravel()[used])})

    for _ in range(rounds if len(centroids) else 0):
        got = blocks.mapInArrow(lambda b, now=centroids: sums(b, now), "cluster int, at int, n long, total long").groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        centroids = centroids.copy()
        for r in got.collect():  # k times size rows
            centroids[r["cluster"], r["at"]] = r["total"] // r["n"]

    def given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, points, tree in _each(batches, size):
            number, dist = nearest(points, tree, centroids)
            yield pa.RecordBatch.from_pydict({"vec_id": pa.array(row["ids"], pa.int64()), "cluster": pa.array(number, pa.int32()), "distance": pa.array(dist, pa.int64())})

    assigned = scratch.stored(blocks.mapInArrow(given, "vec_id long, cluster int, distance long"), "assigned")
    scratch.close(assigned)
    names = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    # a row for each of k centroids at most
    by_cluster = assigned.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia")).withColumn("inertia", F.try_sum("cluster_inertia").over(Window.partitionBy()))
    told = by_cluster.join(spark.createDataFrame(names, "cluster int, centroid_sha256 string"), "cluster")
    return assigned.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    """The same rounds as a chain of common table expressions; every vector meets every centroid, by components."""
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""d{r} AS (SELECT rid, k, list_sum(list_transform(generate_series(1, {SIZE}), lambda i: (a.v[i] - c.v[i]) * (a.v[i] - c.v[i])))::BIGINT AS d FROM kept a CROSS JOIN c{r} c),
a{r} AS (SELECT rid, arg_min(k, (d, k)) AS k, min(d) AS d FROM d{r} GROUP BY rid)""")
        if r < ROUNDS:
            steps.append(f"""s{r} AS (SELECT k, i, sum(x)::BIGINT AS s, count(*)::BIGINT AS n FROM (SELECT a.k, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM kept JOIN a{r} a USING (rid)) GROUP BY k, i),
m{r} AS (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM s{r} GROUP BY k),
c{r + 1} AS (SELECT c.k, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m USING (k))""")
    return f"""
WITH kept AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {SIZE}),
c0 AS (SELECT (row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id::VARCHAR), v) - 1)::INTEGER AS k, v FROM kept QUALIFY k < {CENTROIDS}),
{",".join(steps)}
SELECT vec_id, k AS cluster, d AS distance, sum(d) OVER (PARTITION BY k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM kept JOIN a{ROUNDS} USING (rid) JOIN c{ROUNDS} c USING (k)
"""


SQL = _sql()
