"""Connected components by contraction, all in tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_hot

#: So many edges (16 bytes each) meet in a task at most.
CHUNK = 200_000
EDGE = "a long, b long"


def _forest(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """A star for each component of these edges: (member, least member)."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(len(nodes))
    x, y = ends[: len(a)], ends[len(a) :]
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        # hang the roots of both ends under the lower one, then shorten all paths
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while (far := new[new] < new).any():
            new[far] = new[new][far]
        if (new == label).all():
            break
        label = new
    member = np.flatnonzero(label != np.arange(len(nodes)))
    return pa.RecordBatch.from_pydict({"a": pa.array(nodes[member]), "b": pa.array(nodes[label[member]])})


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
        if sum(len(a) for a, _ in held) >= CHUNK:
            yield _forest(*map(np.concatenate, zip(*held, strict=True)))
            held = []
    if held:
        yield _forest(*map(np.concatenate, zip(*held, strict=True)))


def forest(edges: DataFrame) -> DataFrame:
    """The edges of each partition as stars: fewer of them than the partition has nodes, whatever their number was. No row shuffles."""
    return edges.select("a", "b").mapInArrow(_local, EDGE)


def components(edges: DataFrame, scratch: Scratch, chunk: int = CHUNK) -> DataFrame:
    """node, label for every end of an edge (a, b) of two nodes: one label, a node's number, for each component.

    Each round replaces the edges of each partition by stars, points every node to the neighbour (or itself) with the least hash, and
    contracts nodes into what they point to. Edges inside a contracted node are gone, finished components with them, so that the edges
    shrink from round to round, by a constant part on long paths and at once on stars. What is left when chunk edges would hold it
    is finished by one task. A hub's rows are dealt by salts in every join.
    """
    live, found, turn = scratch.stored(forest(edges), "forest"), None, 0
    while n := live.count():
        if last := n <= chunk:
            to = scratch.stored(forest(live.repartition(1)).withColumnsRenamed({"a": "node", "b": "to"}), "to")
            first = to.select("node", F.col("to").alias("label")).union(to.select("to", F.col("to").alias("label")).distinct())
        else:
            both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
            near = both.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(F.xxhash64("b", F.lit(turn)), F.col("b").alias("to"))).alias("near"), F.count(F.lit(1)).alias("rows"))
            own = F.struct(F.xxhash64("node", F.lit(turn)), F.col("node").alias("to"))
            to = scratch.stored(near.select("node", F.least("near", own)["to"].alias("to"), "rows"), "to")
            first = to.select("node", F.col("to").alias("label"))
        if found is None:
            named = scratch.stored(first, "labels")
        else:
            sizes = found.groupBy("label").agg(F.count(F.lit(1)).alias("nodes"))
            target = scratch.stored(to.select(F.col("node").alias("label"), "to").join(sizes, "label"), "targets")
            named = scratch.stored(join_hot(found, target, "label", "nodes", F.col("node"), "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
            scratch.drop(found, target)
        found = named
        if last:
            scratch.drop(live, to)
            return found
        of_a, of_b = to.withColumnsRenamed({"node": "a", "to": "pa"}), to.withColumnsRenamed({"node": "b", "to": "pb"})
        moved = join_hot(join_hot(live, of_b, "b", "rows", F.col("a")).drop("rows"), of_a, "a", "rows", F.col("b"))
        new = scratch.stored(forest(moved.filter("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b"))), "forest")
        scratch.drop(live, to)
        live, turn = new, turn + 1
    scratch.drop(live)
    return scratch.stored(live.sparkSession.createDataFrame([], "node long, label long"), "labels") if found is None else found
