import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators import confusion as C
from quillspark.operators import correctors, marks
from quillspark.operators import evaluation as E
from quillspark.operators import relational as R
from quillspark.operators import spatial as S
from quillspark.operators import windows as W


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def plain_windows(text, kind, size):
    starts = {"sliding": range(len(text) + 1), "disjoint": range(0, len(text), size), "full": range(max(len(text) - size, 0) + 1)}[kind]
    return [(i, text[i : i + size]) for i in starts]


def test_windows(spark):
    df = spark.createDataFrame([(1, "ab", "AB"), (2, "", "")], "k int, a string, b string")
    assert rows(W.windows(df, "a", "sliding", 1, "b").select("k", "start", "a", "b")) == [(1, 0, "a", "A"), (1, 1, "b", "B"), (1, 2, "", ""), (2, 0, "", "")]
    assert rows(W.windows(df, "a", "disjoint", 5).select("k", "start", "a")) == [(1, 0, "ab")]
    texts = ["", "a", "abc", "abcd", "é🙂\n" * 700, "x" * 512, "y" * 513, "z" * 1024, "w" * 1500]
    table = spark.createDataFrame([*enumerate(texts), (99, None)], "k int, a string")
    for kind in ("sliding", "disjoint", "full"):
        for size in (1, 3, 100, 512, 700):
            got = rows(W.windows(table, "a", kind, size).select("k", "start", "a"), "k", "start")
            assert got == [(k, *w) for k, t in enumerate(texts) for w in plain_windows(t, kind, size)], (kind, size)


def test_windows_cost_a_text_its_length(spark):
    import time

    def seconds(n):
        one = spark.createDataFrame([("ab cd" * (n // 5),)], "a string")
        began = time.time()
        assert W.windows(one, "a", "sliding", 100).agg(F.sum(F.length("a"))).first()[0] == 100 * (n - 100) + 100 * 101 // 2
        return time.time() - began

    seconds(50_000)
    assert seconds(1_000_000) < 20 * max(seconds(100_000), 0.3)


@pytest.mark.parametrize("kind", ["uniform", "triangle", "bell"])
def test_votes_of_a_corrector_that_changes_nothing(spark, kind):
    df = spark.createDataFrame([(1, "a text of some length"), (2, "ab")], "k int, t string")
    assert rows(correctors.correct_ngrams(df, "k", "t", lambda x: x, 5, kind)) == rows(df)


def test_failing_corrector(spark):
    def fragile(texts):
        if "bad" in texts:
            raise ValueError
        return [t.upper() for t in texts]

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None)], "k int, t string").coalesce(1)
    assert rows(correctors.correct(df, "t", fragile).select("k", "pred_text", "error"), "k") == [(1, "A", None), (2, None, "ValueError"), (3, None, None)]


def test_late_and_several_models(spark):
    import time

    def slow(texts):
        if "hang" in texts:
            time.sleep(30)
        return [t.upper() for t in texts]

    df = spark.createDataFrame([(k, "hang" if k == 3 else f"t{k}") for k in range(6)], "k int, t string").coalesce(1)
    began = time.time()
    got = rows(correctors.correct_by_all(df, "t", {"a": slow, "b": lambda x: x}, seconds=0.5).select("k", "a", "a_error", "b", "b_error"), "k")
    assert time.time() - began < 20 and got == [(k, None if k == 3 else f"T{k}", "Late" if k == 3 else None, "hang" if k == 3 else f"t{k}", None) for k in range(6)]


def test_repaired_blanks(spark):
    df = spark.createDataFrame([("ab", " ab", "_WW"), ("ab", "abc", "WWW"), ("ab", "ab", "WW"), (" ab", " abc", "WWWW")], "s string, t string, y string")
    assert [tuple(r["r"]) for r in df.select(X.leading_blank_repaired(F.col("s"), F.col("t"), F.col("y")).alias("r")).collect()] == [("ab", "WW", False), (None, None, True), ("ab", "WW", False), (None, None, True)]


def test_fixed_texts(spark):
    given = [
        ("t1e x", "the $a$ x", "te $a$ x"), (None, "a", "a"), ("a", "odd $", "a"), ("a", r"left \alpha", "a"), ("b c", r"b \citep[see][]{x{y}} c", r"b \cite"), ("q", "", "q r"),
    ]
    got = E.fixed(spark.createDataFrame(given, "ocr string, target string, predicted string")).collect()
    assert [r["evaluated"] for r in got] == [True, False, False, False, True, True]
    assert (got[0]["target_fixed"], got[0]["predicted_fixed"], got[4]["target_fixed"], got[4]["predicted_fixed"]) == ("the ↭ x", "te ↭ x", "b ↫ c", "")
    assert [round(got[0][c], 6) for c in ("cer_orig", "cer_corr", "cer_fix_corr", "cer_fix")] == [round(100 * n / d, 6) for n, d in ((5, 9), (1, 9), (1, 7), (3, 7))]
    assert [round(got[0][c], 6) for c in ("wer_orig", "wer_corr", "wer_fix_corr", "wer_fix")] == [round(100 * n / 3, 6) for n in (2, 1, 1, 2)]
    assert (got[5]["cer_orig"], got[5]["wer_corr"], got[1]["cer_orig"], got[3]["target_fixed"]) == (100.0, 200.0, None, None)


def test_ranks(spark):
    df = spark.createDataFrame([(k * 7919 % 501,) for k in range(501)], "k int").repartition(9)
    assert rows(R.ranked(df, "k", column="r", total="n"), "k") == [(k, k, 501) for k in range(501)]
    assert rows(R.ranked(df.limit(0), "k")) == []


def test_pixels(spark):
    marks_ = spark.createDataFrame([(0, 0, 72 * 65536, 72 * 65536)], "x0 long, y0 long, x1 long, y1 long")
    assert [tuple(r) for r in S.pixel_boxes(marks_, F.lit(1000)).select("xmin", "ymin", "xmax", "ymax").collect()] == [(0, 1000, 287, 713)]
    assert S.hyphenated_words(marks_.withColumnsRenamed({"x0": "a"})).count() == 1


def test_codes(spark):
    df = spark.createDataFrame([("cab",)], "t string")
    vocab = W.vocabulary(df, "t", "@")
    assert rows(vocab, "idx") == [("<UNK>", 3), ("@", 4), ("a", 5), ("b", 6), ("c", 7)]
    index = W.Index(vocab)
    assert df.select(W.encode(F.col("t"), index, 7)).first()[0] == [1, 7, 5, 6, 2, 0, 0]
    assert df.select(W.decode(W.encode(F.col("t"), index), index)).first()[0] == "cab"
    assert df.select(W.encode(F.lit("x"), index)).first()[0] == [1, 3, 2]


def test_splits(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    assert dict(rows(R.fraction_split(df, "k", {"a": 80, "b": 10, "c": 10}).groupBy("split").count())) == {"a": 800, "b": 100, "c": 100}
    with pytest.raises(ValueError, match="100"):
        R.fraction_split(df, "k", {"a": 50})
    dev = R.sample(df, "k", 5, 1)
    assert dev.count() == 5 and R.complement(df, dev, "k").count() == 995
    chunks = [r[1] for r in rows(R.chunk_ids(spark.range(11).withColumnRenamed("id", "k"), "k", 3).select("k", "chunk"))]
    assert chunks == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 2]


def boxes(spark, side, *given):
    return spark.createDataFrame([(1, *b) for b in given], f"page int, {side}_id int, {side}_xmin int, {side}_ymin int, {side}_xmax int, {side}_ymax int")


def test_boxes(spark):
    left = boxes(spark, "l", (1, 0, 0, 10, 10), (2, 20, 0, 200, 100), (3, 300, 300, 310, 310))
    right = boxes(spark, "r", (1, 10, 10, 12, 12), (2, 5, 2, 9, 9), (3, 21, 0, 190, 90), (4, 500, 0, 501, 1))
    pairs = S.overlaps(left, right)
    assert rows(pairs.select("l_id", "r_id")) == [(1, 1), (1, 2), (2, 3)]
    twice = S.overlaps(boxes(spark, "l", (1, 0, 0, 10, 10), (2, 0, 0, 10, 10)), boxes(spark, "r", (7, 0, 0, 10, 10))).withColumn("iou", S.iou())
    assert S.best_matches(twice).first()["l_id"] == 2
    words = spark.createDataFrame([(1, 1, 9, "b"), (1, 2, 3, "b")], "page int, r_id int, r_xmin int, r_text string")
    match = spark.createDataFrame([(1, 1, 5), (1, 2, 5)], "page int, r_id int, l_id int")
    assert rows(S.merged_words(match.join(words, ["page", "r_id"])).select("l_id", "ocr_text", "n_words")) == [(5, "b b", 2)]


def test_hyphen_halves(spark):
    words = spark.createDataFrame([(1, 1, 5, 10, 50), (1, 2, 60, 10, 90), (1, 4, 5, 20, 40)], "page int, ord int, xmin int, ymin int, xmax int")
    broken = spark.createDataFrame([(1, 3, 95, 10, 20, 20, "w-d"), (1, 9, 0, 30, 5, 10, "col"), (2, 1, 0, 1, 2, 3, "alone")], "page int, ord int, xmin int, ymin int, xmax int, ymax int, word string")
    assert rows(S.hyphen_halves(broken, words).select("ord", "half", "xmin", "y", "xmax")) == [(3.0, "top", 95, 10, 40), (3.5, "bottom", 5, 20, 20)]


def test_marks(spark):
    text = r"\newlabel{mStart1}{{pgfid1}}|\newlabel{MEnd1}{{pgfid2}}|\newlabel{mStart2}{{pgfid3}}|\pgfsyspdfmark {pgfid1}{10}{20}|\pgfsyspdfmark {pgfid2}{30}{20}|\pgfsyspdfmark {pgfid3}{1}{1}|\savepicturepage {pgfid1}{2}|\savepicturepage {pgfid2}{2}"
    lines = spark.createDataFrame([("d", x) for x in text.split("|")], "doc string, line string")
    assert rows(marks.aux_positions(lines, "m")) == [("d", 1, 10, 20, 30, 20, 2, 2)]
    assert rows(marks.unpaired(lines, "m")) == [("d", 2, "end")]
    tex = spark.createDataFrame([("d", "\\begin{document}\nA $x y$ b. % gone\nc\n\\end{document}")], "doc string, text string")
    assert [r[2] for r in rows(marks.segments(tex), "pos")] == ["A", "$x y$", "b.", "c"]
    assert [r[2] for r in rows(marks.marked_text(marks.with_marks(tex, "m"), "m"), "mark_id")] == ["A", "$x y$", "b.", "c"]


def test_hocr(spark):
    page = "<p class='ocr_par'><span class='ocr_line' id='l1' title='bbox 0 0 9 9; textangle 90; x_size 30'><span class='ocrx_word' title='bbox 1 2 5 8; x_wconf 93'><em>a&amp;b</em></span> <span class='ocrx_word' title='bbox 6 2 9 8; x_wconf 9'></span></span></p>"
    got = rows(marks.hocr_words(spark.createDataFrame([("d", page)], "doc string, hocr string")).select("x", "y", "w", "h", "conf", "textangle", "fontsize", "baseline0", "text"), "x")
    assert got == [(1, 2, 4, 6, 93, 90.0, 30.0, None, "a&b"), (6, 2, 3, 6, 9, 90.0, 30.0, None, "")]


def test_confusion_and_marks(spark):
    pairs = spark.createDataFrame([("a", "a")] * 3 + [("a", "o"), ("@", "^"), ("@", "x"), ("b", "^")], "pdf_letters string, ocr_letters string")
    frame = C.confusion(pairs)
    assert dict((r["pdf_letters"] + r["ocr_letters"], r["counts"]) for r in frame.collect())["ao"] == 25.0
    got = {(r["pdf"], r["ocr"]): r["counts_unnormalized"] for r in C.subset(frame).collect()}
    assert got == {("a", "a"): 3, ("a", "o"): 1, ("@", "^"): None, ("DELETE", "x"): 1, ("b", "INSERT"): 1} or got[("DELETE", "x")] == 1
    assert [r["token"] for r in C.axis(frame).orderBy("place").collect()] == ["a", "b", "o", "x", "@", "^"]
    walked = spark.createDataFrame([("↭", "↭"), ("↭", "↫"), ("↫", "x"), ("x", "↷")], "t string, p string")
    got = {r["mark"]: tuple(r)[1:] for r in E.precision_recall(E.mark_counts(walked, "t", "p", {"inline": "↭", "cite": "↫", "ref": "↷"})).collect()}
    assert got == {"inline": (1, 0, 0, 2, 1.0, 1.0, 1.0), "cite": (0, 1, 1, 1, 0.0, 0.0, 0.0), "ref": (0, 1, 0, 0, None, None, None)}


def test_ranks_of_a_wide_table(spark):
    n, before = 120_000, spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        wide = spark.range(n).select((F.col("id") * 7919 % n).alias("key"), F.repeat(F.md5(F.col("id").cast("string")), 8).alias("text"), F.lit(1).alias("part"))
        got = R.ranked(wide, "key", total="n")
        assert got.filter("rank <> key or n <> 120000").count() == 0 and got.count() == n and set(got.columns) == {"key", "text", "part", "rank", "n"}
        sizes = {r["chunk"]: (r["n"], r["first"]) for r in R.chunk_ids(wide, "key", 92).groupBy("chunk").agg(F.count("text").alias("n"), F.min("key").alias("first")).collect()}
        assert len(sizes) == 92 and all(sizes[c][0] == n // 92 + (c < n % 92) for c in sizes) and sizes[0][1] == 0
        places = R.shuffled(wide, "key", 3).select("place", "key").collect()
        assert sorted(r["place"] for r in places) == list(range(n)) and len({r["key"] for r in places}) == n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_look_ups_of_a_large_alphabet(spark):
    import time

    text = "".join(map(chr, [*range(32, 127), *range(0x4E00, 0x4E00 + 6000), 0x1F600, 0x10FFFF]))
    df = spark.createDataFrame([(text,), ("a\U0001F600\u4e05z\U0001F601\u00e9",), ("",), (None,)], "t string")
    vocab = W.vocabulary(df.limit(1), "t", "@")
    known = {r["char"]: r["idx"] for r in vocab.collect()}
    index = W.Index(vocab)
    want = [None if t is None else [1, *(known.get(c, known["<UNK>"]) for c in t), 2] for (t,) in df.collect()]
    assert [r[0] for r in df.select(W.encode(F.col("t"), index)).collect()] == want
    back = [r[0] for r in df.select(W.decode(W.encode(F.col("t"), index), index)).collect()]
    assert back == [None if t is None else "".join(c if c in known else "<UNK>" for c in t) for (t,) in df.collect()]
    assert df.select(W.replace_unknown(F.col("t"), index)).collect()[1][0] == "a\U0001F600\u4e05z  "
    long = spark.range(200).select(F.lit(text[95:595] * 20).alias("t"))
    began = time.time()
    assert long.agg(F.sum(F.size(W.encode(F.col("t"), index)))).first()[0] == 200 * 10_002
    assert time.time() - began < 20


def test_places_by_document(spark):
    rows_in = [("a", 1, 4), ("a", 1, 2), ("b", 1, 3), ("b", 1, 1), ("b", 2, 9)]
    df = spark.createDataFrame(rows_in, "doc string, page int, mark_id int")
    assert rows(marks.reading_order(df)) == [("a", 1, 2, 1), ("a", 1, 4, 2), ("b", 1, 1, 1), ("b", 1, 3, 2), ("b", 2, 9, 1)]


def test_boxes_by_page_are_those_of_the_join(spark, monkeypatch):
    """A row with a page's boxes gives the pairs, best matches and words of the join, without an exchange; slices of one page too."""
    import random

    rng = random.Random(3)
    box = lambda k: (k, *(lambda x, y: (x, y, x + rng.randrange(150), y + rng.randrange(150)))(rng.randrange(-300, 300), rng.randrange(-300, 300)))
    sides = "array<struct<id:int,xmin:int,ymin:int,xmax:int,ymax:int{}>>"
    rows = [(page, [box(k) for k in range(40)], [(*box(k), f"w{k % 5}") for k in range(50)]) for page in range(3)] + [(7, [], []), (8, None, None)]
    pages = spark.createDataFrame(rows, f"page long, left {sides.format('')}, right {sides.format(',text:string')}")
    one = lambda c, s, *more: pages.select("page", F.inline(c)).select("page", F.col("id").alias(f"{s}_id"), *(F.col(x).alias(f"{s}_{x}") for x in ("xmin", "ymin", "xmax", "ymax", *more)))
    pairs = S.overlaps(one("left", "l"), one("right", "r", "text"), pad=8)
    best = S.best_matches(pairs.withColumn("iou", S.iou()), "iou", "r_xmin", "r_text")
    monkeypatch.setattr(S, "SLICE", 60)
    plain = lambda df, *columns: sorted(map(tuple, df.select(*columns).collect()))
    assert plain(S.page_overlaps(pages, pad=8), "page", "l_id", "r_id") == plain(pairs, "page", "l_id", "r_id")
    assert plain(S.page_matches(pages, pad=8), "page", "r_id", "l_id", "iou") == plain(best, "page", "r_id", "l_id", "iou")
    merged = S.page_merged_words(pages, pad=8)
    assert plain(merged, "page", "l_id", "ocr_text", "n_words") == plain(S.merged_words(best), "page", "l_id", "ocr_text", "n_words")
    assert "Exchange" not in merged._jdf.queryExecution().executedPlan().toString()


def test_marks_are_set_in_the_row_that_holds_the_text(spark):
    """Words were dealt by document, with their marks."""
    body = lambda t: f"\\begin{{document}}\n{t}\n\\end{{document}}"
    tex = spark.createDataFrame([("a", body("x $y z$ % w\nv")), ("b", body("  ")), ("c", None), ("d", body("u"))], "doc string, text string")
    marked = marks.with_marks(tex, "m")
    assert "Exchange" not in marked._jdf.queryExecution().executedPlan().toString()
    start, end = (lambda k: f"\\tikzmark{{mStart{k}}}"), (lambda k: f"\\tikzmark{{mEnd{k}}}")
    assert rows(marked, "doc") == [("a", " ".join(f"{start(k)}{w}{end(k)}" for k, w in enumerate(["x", "$y z$", "v"]))), ("d", f"{start(0)}u{end(0)}")]


def test_first_window_with_a_character(spark):
    """A least pair of key and start was found by sorting every window's characters."""
    wins = spark.createDataFrame([(5, 0, "ab"), (5, 50, "c"), (-3, 100, "b"), (-3, 50, "bd"), (1 << 40, 0, "z"), (7, 0, ""), (7, 0, None)], "k long, s int, w string")
    found = W.first_with_character(wins, "k", "s", "w")
    assert found.dtypes == [("char", "string"), ("k", "bigint"), ("s", "int")]
    assert rows(found, "char") == [("a", 5, 0), ("b", -3, 50), ("c", 5, 50), ("d", -3, 50), ("z", 1 << 40, 0)]
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_models_share_a_worker_and_hand_texts_back_in_parts(spark, monkeypatch):
    """Each model had a worker of its own, that held all of a batch's texts and results."""
    seen = lambda xs: [f"{x}{len(xs)}" for x in xs]
    df = spark.createDataFrame([(k, None if k % 7 == 3 else f"t{k}-") for k in range(100)], "k long, t string").repartition(1)
    monkeypatch.setattr(correctors, "HANDED", 16)
    got = correctors.correct_by_all(df, "t", {"a": lambda xs: [x.upper() for x in xs], "b": seen})
    assert got._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [") == 1
    assert [(r["k"], r["a"], r["a_error"], r["b_error"]) for r in got.orderBy("k").collect()] == [(k, None if k % 7 == 3 else f"T{k}-", None, None) for k in range(100)]


def test_pieces_are_short_for_their_windows():
    """A window's place is found by counting from its piece's start: pieces of 512 made windows of 100 cost 1.4 times as much."""
    assert W.PIECE <= 128
