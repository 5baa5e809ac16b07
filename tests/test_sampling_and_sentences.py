import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.operators import relational as R
from quillspark.operators import sentences as S
from quillspark.operators import spatial


def test_articles_are_drawn_first(spark):
    pages = spark.createDataFrame([("a", 0), ("b", 0), ("b", 0), *(("c", k) for k in range(98)), (None, 1)], "article string, page int").cache()
    first = Counter()
    for seed in range(120):
        rows = R.article_first_samples(pages, "article", "page", {"x": 1}, seed).collect()
        first[rows[0]["article"]] += 1
    # four articles, each as likely as any other whatever its pages
    assert all(abs(first[a] - 30) < 5 * math.sqrt(120 * 3 / 16) for a in ("a", "b", "c", None)), first
    rows = R.article_first_samples(pages, "article", "page", {"x": 2, "y": 3}, 1).orderBy("rank").collect()
    assert [r["sample"] for r in rows] == ["x", "x", "y", "y", "y"] and len({(r["article"], r["page"]) for r in rows}) == 5
    assert R.article_first_samples(pages, "article", "page", {"x": 500}).count() == 101
    assert R.article_first_samples(pages.limit(0), "article", "page", {"x": 5}).count() == 0


def test_planted_abbreviations_end_no_sentence(spark):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdeiou", k=rng.randint(2, 7))) for _ in range(300)]
    texts = []
    for i in range(200):
        made = []
        for _ in range(6):
            w = rng.choices(words, k=8)
            if rng.random() < 0.7:
                w[3] = rng.choice(["Fig.", "e.g.", "Dr."])
            made.append(" ".join(w) + rng.choice([".", "!", "?"]))
        texts.append((i, " ".join(made)))
    texts += [(900, None), (901, ""), (902, "One line\nAnother e.g.\nthird. And fourth"), (903, "Fig. 3 shows it.  Next.")]
    df = spark.createDataFrame(texts, "k int, text string")
    known = S.abbreviations(df)
    assert {r["word"] for r in known.collect()} == {"fig", "e.g", "dr"}
    got = {}
    for r in S.sentences(df, "k", "text", known).orderBy("k", "sentence_no").collect():
        got.setdefault(r["k"], []).append(r["sentence"])
    assert all(len(got[i]) == 6 and " ".join(got[i]) == t for i, t in texts[:200])
    assert got[902] == ["One line", "Another e.g.", "third.", "And fourth"] and got[903] == ["Fig. 3 shows it.", "Next."] and 900 not in got and 901 not in got


def plain_union(hyphens, words, reach, far):
    """Broken words one after the other, each over all words and halves of its page."""
    out, seen = [], [(p, o, x, y, z) for p, o, x, y, z in words]
    for p, o, x, y, z, y1, w in sorted(hyphens):
        def near(limit, p=p, o=o, y=y, y1=y1):
            return [s for s in seen if s[0] == p and o - limit <= s[1] < o and s[3] <= y], [s for s in seen if s[0] == p and o < s[1] <= o + limit and s[3] >= y1]

        before, after = near(reach)
        left, right = before or after, after or before
        if not left:
            before, after = near(reach * far)
            left = right = before + after
        if left and y <= y1:
            low, high = min(s[2] for s in left), max(s[4] for s in right)
            seen += [(p, o, x, y, high), (p, o + 0.5, low, y1, z)]
            out += [(p, float(o), "top", x, y, high, w), (p, o + 0.5, "bottom", low, y1, z, w)]
    return out


@pytest.mark.parametrize("batch", [7, 10_000])
def test_halves_lean_on_earlier_halves(spark, batch):
    rng = random.Random(2)
    words, hyphens = [], []
    for page in range(5):
        for o in range(200):
            line = o // 8
            x = (o % 8) * 30
            if rng.random() < (0.9 if 40 < o < 90 else 0.3):
                hyphens.append((page, o, x, line, x + 20, line + rng.choice([1, 1, 1, -1]), f"w{o}"))
            else:
                words.append((page, o, x, line, x + 25))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        h = spark.createDataFrame(hyphens, "page int, ord int, xmin int, ymin int, xmax int, ymax int, word string")
        w = spark.createDataFrame([(*r, "x") for r in words], "page int, ord int, xmin int, ymin int, xmax int, word string")
        got = spatial.hyphen_union(h, w, 3, 4)
        assert sorted(map(tuple, got.collect())) == sorted(plain_union(hyphens, words, 3, 4))
        assert spatial.hyphen_union(h.limit(0), w).count() == 0 and spatial.hyphen_union(h.filter(F.col("ord") == 0), w.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_halves_of_pages_in_rows(spark):
    """A row holds a page's words, in any order: the halves are those of the words dealt by page, which were dealt and swept one by one."""
    rng = random.Random(4)
    boxes = []
    for page in range(40):
        for o in range(rng.choice([1, 3, 60, 200])):
            line, x = o // 8, (o % 8) * 30
            broken = rng.random() < (0.95 if 40 < o < 90 else 0.3)
            boxes.append((page, (o, broken, x, line, x + rng.choice([20, 25]), line + (rng.choice([1, 1, 1, -1]) if broken else 0), f"w{o}")))
    rng.shuffle(boxes)
    flat = spark.createDataFrame(boxes, "page long, b struct<ord: int, broken: boolean, xmin: int, ymin: int, xmax: int, ymax: int, word: string>").select("page", "b.*").cache()
    held = flat.groupBy("page").agg(F.collect_list(F.struct(F.col("ord").alias("id"), "broken", "xmin", "ymin", "xmax", "ymax", "word")).alias("boxes"))
    h, w = flat.filter("broken").drop("broken"), flat.filter("NOT broken").select("page", "ord", "xmin", "ymin", "xmax")
    rows = lambda df: sorted(map(tuple, df.select("page", "ord", "half", "xmin", "y", "xmax", "word").collect()))
    for reach, far in ((3, 4), (25, 5)):
        halves, union = spatial.page_hyphen_halves(held, reach, far), spatial.page_hyphen_union(held, reach, far)
        assert rows(halves) == rows(spatial.hyphen_halves(h, w, reach, far)) and rows(union) == rows(spatial.hyphen_union(h, w, reach, far)) != rows(halves)
    assert rows(spatial.page_hyphen_union(held.limit(0))) == []
