import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from quillspark.llm import license_scan as L

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"
MIT = next(iter(L.NOTICES))


def longest(matches):
    """Longest sequence of matches (p, q) that grows in both."""
    best = {}
    for p, q in sorted(matches):
        best[p, q] = 1 + max((n for (a, b), n in best.items() if a < p and b < q), default=0)
    return max(best.values())


def plain(text):
    w = re.findall(L.WORD, (text or "").translate(FOLD))
    base, labels, score = [], set(), 0.0
    for phrase, label in L.PHRASES.items():
        t = phrase.split()
        base += [(i, label) for i in range(len(w)) if w[i : i + len(t)] == t]
    for notice, label in L.NOTICES.items():
        t = notice.split()
        grams = [tuple(t[q : q + L.NOTICE_K]) for q in range(len(t) - L.NOTICE_K + 1)]
        at = defaultdict(list)
        for p in range(len(w) - L.NOTICE_K + 1):
            for q, g in enumerate(grams):
                if tuple(w[p : p + L.NOTICE_K]) == g:
                    at[p - q].append((p, q))
        for d in at:
            part = longest([m for e in range(d, d + L.DRIFT + 1) for m in at.get(e, [])]) / len(grams)
            score = max(score, part)
            if part >= L.COVER:
                labels.add(label)
    places = [i for i, _ in base]
    both = {x for _, x in base}
    return len(w), len(base), min(places, default=None), max(places, default=None), ",".join(sorted(both)), ",".join(sorted(both | labels)), 1.0 if base else score


def snippets(notice, step=1, k=4):
    w = notice.split()
    return " ".join(" ".join(w[i : i + k]) for i in range(0, len(w) - k + 1, step))


def texts():
    rng = random.Random(11)
    words = MIT.split()
    yield from (None, "", "mit license", "MIT-License " * 40, MIT.upper(), snippets(MIT), " ".join(reversed(words)), " ".join(words[10:] + words[:10]), MIT + " x " + MIT, (MIT + " y ") * 60)
    yield MIT.replace("free of", "free as it were of").replace("copy of", "copy or copies of")
    yield MIT.replace("to any person", "to person").replace("this software", "software")
    yield " ".join(w + (" z" * 3 if k % 4 == 3 else "") for k, w in enumerate(words))
    for notice in L.NOTICES:
        for _ in range(6):
            w = notice.split()
            for _ in range(rng.randint(0, 6)):
                k = rng.randrange(len(w))
                w[k : k + rng.choice([0, 1])] = rng.choice([[], ["new"], ["a", "b"], w[k : k + 3] * 2])
            yield "start " + " ".join(w) + " end"
        yield snippets(notice, 2) + " apache license"
    pool = " ".join(L.NOTICES).split()
    for _ in range(30):
        parts = [pool[(k := rng.randrange(len(pool))) : k + rng.randint(3, 12)] for _ in range(8)]
        yield " ".join(x for part in parts for x in part)


def test_scan_is_brute_force(make):
    given = list(texts())
    rows = {r["doc_id"]: r for r in L.scan(make(list(enumerate(given)))).collect()}
    for i, t in enumerate(given):
        r, want = rows[i], plain(t)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) == want[:-1], (i, t)
        assert r["score"] == pytest.approx(want[-1])


def test_spans_are_verified_in_order(make):
    words = MIT.split()
    cases = {0: (snippets(MIT), ""), 1: (" ".join(reversed(words)), ""), 2: (MIT.replace("free of", "free as it were of"), "mit"), 3: (MIT.replace("to any person", "to person"), "mit"), 4: (MIT, "mit"), 5: (" ".join(words[:8]), "")}
    got = {r["doc_id"]: r for r in L.scan(make([(k, t) for k, (t, _) in cases.items()])).collect()}
    assert {k: r["labels"] for k, r in got.items()} == {k: label for k, (_, label) in cases.items()}
    assert got[0]["score"] < L.COVER and got[4]["score"] == 1.0


def test_scan_is_its_sql(spark, make):
    con = duckdb.connect()
    given = make(list(enumerate(texts()))).select("doc_id", "text")
    con.register("documents", given.toPandas())
    want = con.sql(L.SQL)
    got = L.scan(given)
    tidy = lambda rows: Counter(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows)
    assert tidy(got.select(*want.columns).collect()) == tidy(want.fetchall())
