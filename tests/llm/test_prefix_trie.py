import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from quillspark.llm import prefix_trie as T

SF = "/root/testdata/sf0.001"


def tie(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def plain(rows):
    """The contract, node by node."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, tie(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    built = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + t[h:]
    members = defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    total = {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(T.WORD, node[-1][1])) if node else 0
        kids = children[node]
        total[node] = (sum(total[k][0] for k in kids) if kids else 1, (len(members[node]) - 1) * words + sum(total[k][1] for k in kids))
    return Counter(
        (min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children[node]), *total[node], hashlib.sha256(",".join(map(str, sorted(c for c in m if len(built[c]) == len(node)))).encode()).hexdigest())
        for node, m in members.items()
    )


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "conv_id long, turn long, role string, text string, low int, seq string, depth int")


def check(spark, rows):
    got = T.trie(table(spark, rows))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert Counter(map(tuple, got.collect())) == plain(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_is_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(T, "PIECE", 3)
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 50), *range(100, 140), -3, -20, -27, 1000, 1001]:
        for t in range(rng.choice([1, 2, 3, 6])):
            rows.append((c, t, ("user", "assistant")[t % 2], rng.choice(["hi there", "hi  there", "", "日本 語", None, "one two three"])))
    # a conversation that many repeat, null and repeated turns, null roles and texts, a very long text, ids whose head's conversation is absent
    rows += [(c, t, "user", f"same {t}") for c in range(2000, 2060) for t in range(5)]
    rows += [(70, None, None, None), (70, 0, None, ""), (70, 0, "user", "b"), (70, 0, "user", "b"), (70, 0, "user", "a"), (71, 3, "user", "word " * 30_000), (None, 1, "user", "no conversation"), (333, 0, "user", "x"), (337, 0, "user", "x")]
    rng.shuffle(rows)
    check(spark, rows)


def test_shared_turns_cost_no_rounds(spark, monkeypatch):
    counted = []
    inside = T.refine
    monkeypatch.setattr(T, "refine", lambda *a: counted.append(inside(*a)) or counted[-1])
    rows = [(c, t, "user", f"turn {t}" if t < 400 or c == 20 else f"other {c} {t}") for c in (20, 40, 60) for t in range(405)]
    check(spark, rows)
    assert len(counted[0]) <= 4


def test_small_tables(spark):
    assert T.trie(table(spark, [])).count() == 0
    assert T.trie(table(spark, [(None, 1, "user", "a")])).count() == 0
    # a conversation all of whose turns are cut, and whose head is absent: a turnless member of the root
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    check(spark, [(c, 0, "user", "a b"), (c, 1, "assistant", "b")])
    check(spark, [(c, 0, "user", "a b"), (500, 0, "user", "a b"), (500, 1, "user", "c")])


def test_trie_is_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = con.sql(T.SQL)
    got = T.query(spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(want.fetchall())
