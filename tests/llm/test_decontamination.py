import hashlib
import random
import re
from collections import Counter

import duckdb
import pytest

from quillspark.llm import decontamination as D

SF = "/root/testdata/sf0.001"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(D.WORD, (text or "").translate(FOLD))


def plain(docs, items, width=10):
    windows = {}
    for item, text in items:
        w = words(text)
        k = min(len(w), width)
        for i in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        w, hit, got = words(text), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if (found := windows.get(tuple(w[i : i + k]))) is not None:
                    hit |= set(range(i, i + k))
                    got |= {str(x) for x in found if x is not None}
        out.append((doc_id, len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit)))
    return out


def tables(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, 1, 2, "p", 0) for i, t in docs], "doc_id long, text string, row int, pair int, pos string, test int"),
        spark.createDataFrame([(i, t, 1, 2, "p") for i, t in items], "item_id long, text string, n int, row int, q string"),
    )


def random_tables(seed, short=True):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "é", "日本", "a1", *(f"w{k}" for k in range(40))]
    prose = lambda n: " ".join(rng.choices(vocabulary, weights=[20, 15, 3, 2, 2, *[1] * 40], k=n))
    items = [(k, prose(rng.randint(10, 40))) for k in range(25)]
    items += [(5, items[5][1]), (30, items[3][1]), (31, "the " * 12), (None, items[7][1]), (32, None), (33, " -- "), (34, items[0][1] + " " + items[1][1])]
    if short:
        items += [(40, "w1 w2 w3"), (41, "Zebra!"), (42, "of"), (43, "w39 w38"), (44, "the the")]
    docs = []
    for k in range(60):
        parts = [prose(rng.randint(0, 60)) for _ in range(3)]
        if k % 3 == 0:
            w = words(items[rng.randrange(25)][1])
            a = rng.randint(0, max(len(w) - 10, 0))
            parts.insert(1, ", ".join(w[a : a + rng.randint(8, 20)]).upper())
        docs.append((k, "\n".join(parts)))
    docs += [(100, None), (101, ""), (None, items[2][1]), (None, None), (7, "the " * 3000), (7, "the " * 3000), (102, "x" * 20_000), (103, " ".join(t for _, t in items if t)), (104, "zebra")]
    return docs, items


@pytest.mark.parametrize(("seed", "short", "broadcast"), [(1, True, True), (2, False, True), (3, True, False)])
def test_scan_is_brute_force(spark, monkeypatch, seed, short, broadcast):
    if not broadcast:
        monkeypatch.setattr(D, "BROADCAST_PAIRS", -1)
        monkeypatch.setattr(D, "BROADCAST_LOOKUPS", -1)
    docs, items = random_tables(seed, short)
    got = D.scan(*tables(spark, docs, items))
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert Counter(map(tuple, got.collect())) == Counter(plain(docs, items))


def test_empty_tables(spark):
    docs, items = random_tables(4)
    assert D.scan(*tables(spark, [], items)).count() == 0
    assert Counter(map(tuple, D.scan(*tables(spark, docs, [])).collect())) == Counter(plain(docs, []))
    assert Counter(map(tuple, D.scan(*tables(spark, docs, [(1, None), (2, "")])).collect())) == Counter(plain(docs, []))


def near(docs, items, width, slop, missing):
    """Every window by its rarest pairs, as near_matches() says."""
    pairs = lambda w: list(zip(w, w[1:], strict=False))
    texts = {}
    for item, text in items:
        if len(w := words(text)) > 1:
            texts.setdefault(tuple(w), set()).add(item)
    of = {d: [(i, p) for i, p in enumerate(pairs(words(t)))] for d, t in docs}
    df = Counter(p for places in of.values() for _, p in places)
    out = {}
    for w, names in texts.items():
        p = pairs(list(w))
        size = min(len(p), width - 1)
        if size <= missing:
            continue
        for start in range(len(p) - size + 1):
            window = p[start : start + size]
            for _, j in sorted((df[x], j) for j, x in enumerate(window))[: missing + 1]:
                for d, places in of.items():
                    for pos in (i for i, x in places if x == window[j]):
                        held = sum(any(x == y and abs(i - pos - (m - j)) <= slop for i, y in places) for m, x in enumerate(window))
                        if held >= size - missing:
                            for name in names:
                                key = (d, str(name), start, pos - j)
                                out[key] = max(out.get(key, 0), held)
    return Counter((*k, v) for k, v in out.items())


def test_near_matches(spark):
    rng = random.Random(8)
    prose = lambda n: [f"w{int(30 * rng.random() ** 2)}" for _ in range(n)]
    items = [(k, " ".join(prose(rng.randint(8, 30)))) for k in range(10)] + [(20, "w1 w2"), (21, "w3")]
    docs = []
    for k in range(20):
        w = words(items[k % 10][1])
        at = rng.randrange(3, len(w) - 2)
        changed = {0: w[:at] + w[at + 1 :], 1: [*w[:at], "new", *w[at:]], 2: [*w[:at], "other", *w[at + 1 :]], 3: w}[k % 4]
        docs.append((k, " ".join(prose(10) + changed + prose(10))))
    got = Counter(map(tuple, D.near_matches(*tables(spark, docs, items), width=8, slop=1, missing=3).collect()))
    assert got == near(docs, items, 8, 1, 3)
    planted = {(d, i) for d, i, *_ in got}
    assert all((k, str(k % 10)) in planted for k in range(20))


def test_scan_is_its_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(D.SQL)
    got = D.query(spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(want.fetchall())
