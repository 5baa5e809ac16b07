import hashlib
import math

import duckdb
import numpy as np
import pytest

from quillspark.llm import clustering as C

SF = "/root/testdata/sf0.001"


def kinds():
    rng = np.random.default_rng(3)
    yield rng.normal(size=(700, 64)) * 20
    yield rng.normal(size=(900, 3)) * 2  # many equal points and equal distances
    yield np.repeat(rng.normal(size=(9, 64)) * 90, 100, axis=0) + rng.normal(size=(900, 64))
    yield np.zeros((50, 5))
    yield rng.normal(size=(1, 4)) * 9


@pytest.mark.parametrize("points", [np.floor(x).astype(np.int64) for x in kinds()], ids=["even", "ties", "groups", "equal", "one"])
def test_dual_tree_is_brute_force(points, monkeypatch):
    order, tree = C.cover_tree(points)
    inside = points[order]
    assert sorted(order.tolist()) == list(range(len(points)))
    for i, (a, z) in enumerate(zip(tree.begin, tree.end, strict=True)):
        assert (np.sqrt(C.squared(inside[a:z], inside[tree.centre[i]])) <= tree.radius[i] + 1e-9).all()
        if tree.last[i]:
            kids = slice(tree.first[i], tree.last[i])
            assert tree.begin[kids][0] == a and tree.end[kids][-1] == z and (tree.begin[kids][1:] == tree.end[kids][:-1]).all()
            centres = inside[tree.centre[kids]]
            apart = np.sqrt(C.squared(centres[:, None], centres[None])) + np.eye(len(centres)) * 1e9
            assert (apart > tree.radius[i] / 2).all()
    rng = np.random.default_rng(4)
    for pairs in (C.PAIRS, 40):
        monkeypatch.setattr(C, "PAIRS", pairs)
        for k in (1, 2, 7, 16):
            centroids = inside[rng.integers(0, len(inside), k)] + rng.integers(0, 2, (k, inside.shape[1]))
            every = C.squared(inside[:, None], centroids[None])
            number, dist = C.nearest(inside, tree, centroids)
            assert (number == every.argmin(axis=1)).all() and (dist == every.min(axis=1)).all()


def test_nodes_are_given_whole():
    centres = np.random.default_rng(5).integers(-500, 500, (8, 64))
    points = np.repeat(centres, 100, axis=0) + np.random.default_rng(6).integers(-3, 4, (800, 64))
    order, tree = C.cover_tree(points)
    of, tops = C.cover_tree(centres, 1)
    owned, (left, _) = C.walk(points[order], tree, centres[of], of, tops)
    assert sum(len(nodes) for nodes, _ in owned) <= 16 and not len(left)


def lloyd(rows, k=C.CENTROIDS, rounds=C.ROUNDS, size=C.SIZE):
    kept = [(i, [max(-C.LARGEST, min(C.LARGEST, math.floor(64 * x))) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"1:{'null' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    centroids = [v for _, v in start]
    for turn in range(rounds + 1):
        own = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids]
            own.append((min(d), d.index(min(d))))
        if turn < rounds:
            for c in range(len(centroids)):
                if mine := [v for (_, v), (_, n) in zip(kept, own, strict=True) if n == c]:
                    centroids[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    total = sum(d for d, _ in own) if kept else 0
    by = {c: sum(d for d, n in own if n == c) for c in range(len(centroids))}
    return sorted(((i, n, d, by[n], total, hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(kept, own, strict=True)), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 0.5) for i, v in rows], "vec_id long, embedding array<float>, cluster int, v string, distance double")


def test_clusters_are_lloyds(spark):
    rng = np.random.default_rng(7)
    some = [(i, [float(np.float32(x)) for x in rng.normal(size=64)]) for i in range(60)]
    odd = [(100, None), (101, [1.0] * 63), (102, [1.0] * 63 + [None]), (103, [float("nan")] * 64), (104, [float("inf")] * 64), (None, [0.25] * 64), (5, [0.5] * 64), (5, [0.5] * 64), (105, [0.0] * 64), (106, [])]
    got = C.cluster(table(spark, some + odd))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == lloyd(some + odd)
    few = [(1, [0.1] * 64), (2, [0.1] * 64), (3, [1e9] * 64)]
    few = [(i, [float(np.float32(x)) for x in v]) for i, v in few]
    assert sorted(map(tuple, C.cluster(table(spark, few)).collect()), key=repr) == lloyd(few)
    assert C.cluster(table(spark, [])).count() == 0 and C.cluster(table(spark, odd[:5])).count() == 0


def test_clusters_are_their_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.sql(C.SQL)
    got = C.query(spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(tuple(r) for r in got.select(*want.columns).collect()) == sorted(want.fetchall())
