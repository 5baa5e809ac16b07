import random

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import bitvectors, editing, markup
from quillspark.functions import text as X


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, d in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (c != d))
    return row[-1]


short = st.text(alphabet="abc", max_size=12)


@settings(max_examples=300, deadline=None)
@given(short, short)
def test_scripts_are_shortest_and_alignments_give_the_texts_back(a, b):
    assert len(editing.edit_script(a, b)) == levenshtein(a, b) == editing.distance(a, b)
    x, y, s, t = editing.align(a, b)
    assert len(x) == len(y) == len(s) == len(t)
    assert x.replace("^", "") == a and y.replace("@", "") == b


@settings(max_examples=200, deadline=None)
@given(short, short)
def test_scripts_of_far_texts(a, b):
    most, editing.MOST_WAVES = editing.MOST_WAVES, 1
    try:
        assert len(editing.edit_script(a, b)) == levenshtein(a, b)
        x, y, *_ = editing.align(a, b)
        assert x.replace("^", "") == a and y.replace("@", "") == b
    finally:
        editing.MOST_WAVES = most


def test_worked_alignments():
    assert editing.edit_script("cot", "cart") == [("replace", 1, 1), ("insert", 2, 2)]
    assert editing.align("cot", "cart") == ("co^t", "cart", "WW^W", "WWWW")
    assert editing.edit_script("abxc", "abc") == [("delete", 2, 2)]
    assert editing.align("abxc", "abc")[:2] == ("abxc", "ab@c")


def test_brackets_and_commands():
    assert markup.matching("a(b(c)d)") == ({3: 5, 1: 7}, False)
    assert markup.matching("a(b")[1] and not markup.matching("a(b", check=False)[1]
    assert markup.command_span(r"x \cite[a]{b{c}} d", r"\cite") == (2, 16)
    assert markup.command_span("none", r"\cite") == (-1, -1)
    assert markup.mask_commands(r"a \citep[see][]{x{y}} b \cite c \cite{d}", r"\cite", "↫") == "a ↫ b ↫"
    assert markup.tag_characters(r"ab $x$ \cite{k} \%") == "WWWIIIWCCCCCCCCWSS"


def column(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t"))).first()[0]


def test_masks(spark):
    assert column(spark, "a $x$ b $y$", X.mask_inline_target) == "a ↭ b ↭"
    assert column(spark, "a $x$ b $y", X.mask_inline_target) is None
    assert column(spark, "a $x$ b $y", X.mask_inline_prediction) == "y"
    assert column(spark, r"a \citep[see][]{a{b}} c", lambda c: X.mask_command(c, "cite", "↫")) == "a ↫ c"
    assert column(spark, r"left \alpha", X.has_residual_command) is True
    assert column(spark, "nothing $`*", X.has_residual_command) is False


def test_fill_types(spark):
    cases = {"WW@@ @C@": "WWWW @CC", "@WW": "WWW", "@@W": "@@W", "@ W": "@ W", "@": "@", "": ""}
    got = spark.createDataFrame(list(cases.items()), "t string, want string").select("want", X.fill_types(F.col("t")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)


def test_distance_bands_agree(spark):
    pairs = [("a" * 300, "b" * 300), ("kitten", "sitting"), ("", "abc"), ("x" * 100, "x" * 60), ("a" * 9000, "b" * 9000), ("same", "same"), (None, "a"), ("a", None), ("", "")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", X.edit_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert [r["d"] for r in rows] == [300, 3, 3, 40, 9000, 0, None, None, 0]


def test_rates_and_cells(spark):
    assert column(spark, "", lambda c: X.error_rate(F.lit(2), F.length(c))) == 200.0
    assert column(spark, "@", lambda c: X.clear_cell(c, "@")) == "" and column(spark, "a@", lambda c: X.clear_cell(c, "@")) == "a@"
    assert column(spark, "<START>ab<END>cd", X.clean_decoded) == "ab"
    assert column(spark, "ab c", lambda c: X.keep_by_type(c, F.lit("WI W"))) == "a c"
    assert column(spark, "One. Two!\nThree", X.sentences) == ["One.", "Two!", "Three"]
    assert column(spark, "x", lambda c: X.fixed_number(F.lit(None).cast("double"))) == "NaN"


def test_aligned_column_with_nulls(spark):
    rows = spark.createDataFrame([("cot", "cart"), (None, "a"), ("", "")], "o string, g string").select(editing.aligned_column(F.col("o"), F.col("g")).alias("a")).select("a.*").collect()
    assert rows[0]["ocr_aligned"] == "co^t" and rows[1]["ocr_aligned"] is None and rows[2]["gt_aligned"] == ""


def test_word_distance(spark):
    many = " ".join(f"w{k}" for k in range(60_000))
    frame = pd.DataFrame({"a": ["the cat sat", "x", "", many, None], "b": ["the bat sat down", "x", "y z", f"{many} more", "x"]})
    got = editing.with_word_distances(spark.createDataFrame(frame), d=("a", "b"))
    assert got.columns == ["a", "b", "d"] and [r["d"] for r in got.collect()] == [2, 0, 2, 1, None]
    assert [r[0] for r in spark.createDataFrame([("a b",), ("",), (" x ",)], "t string").select(editing.words(F.col("t"))).collect()] == [2, 0, 1]


def plain_tags(text):
    """Codes by the definition: every character's strongest span."""
    import re

    types = ["W"] * len(text)

    def paint(a, b, code, over=None):
        for i in range(a, b):
            if over is None or types[i] == over:
                types[i] = code

    dollars = [i for i, c in enumerate(text) if c == "$"]
    for a, b in zip(dollars[::2], dollars[1::2]):
        paint(a, b + 1, "I")
    for code, command in (("C", "\\cite"), ("R", "\\ref")):
        at = 0
        while (here := text.find(command, at)) >= 0:
            _, end = markup.command_span(text, command, check=False, start=here)
            at = max(end, here + len(command))
            if end > 0:
                paint(here, end, code)
    for m in re.finditer(r"\\[%&]", text):
        if types[m.start() : m.end()] == ["W", "W"]:
            paint(m.start(), m.end(), "S")
    pairs, _ = markup.matching(text, "{", "}", check=False)
    for a, b in pairs.items():
        begin = a
        while begin and text[begin - 1].isalpha():
            begin -= 1
        if begin and begin < a and text[begin - 1] == "\\":
            paint(begin - 1, b + 1, "O", "W")
    for a, b in pairs.items():
        paint(a, b + 1, "B", "W")
    return "".join(types)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["{", "}", "$", "\\cite", "\\ref", "\\em", "\\%", "a", " ", "\\"]), max_size=14).map("".join))
def test_tags_are_the_strongest_spans(text):
    assert markup.tag_characters(text) == plain_tags(text)


def test_deep_nesting_costs_its_length():
    import time

    began = time.time()
    assert set(markup.tag_characters("{" * 200_000 + "}" * 200_000)) == {"B"}
    assert time.time() - began < 5


def test_checked_spans(spark):
    cases = {r"x \cite{a} y": (2, 10, None), r"\cite{a} }": (0, 8, "uneven"), r"\cite{a": (-1, -1, "open"), "none": (-1, -1, "none")}
    got = spark.createDataFrame([(t,) for t in cases], "t string").select("t", markup.command_span_column(F.col("t"), "\\cite").alias("s")).select("t", "s.*").collect()
    assert {r["t"]: tuple(r)[1:] for r in got} == cases


def test_plain_text_and_labels(spark):
    assert column(spark, r"\textbf{a \alpha} -- \foo b~c", markup.plain_text) == "a α – b c"
    assert column(spark, "if", X.label_escaped) == '"if"' and column(spark, "a\n\\", X.label_escaped) == "a\\n\\\\"
    assert column(spark, "a^b@", X.one_gap) == "a@b@" and column(spark, "x", lambda c: X.thousands(F.lit(1234567))) == "1,234,567"


def test_edit_script_column(spark):
    got = spark.createDataFrame([("cot", "cart"), (None, "a")], "a string, b string").select(editing.edit_script_column(F.col("a"), F.col("b")).alias("s")).collect()
    assert [tuple(x) for x in got[0]["s"]] == [("replace", 1, 1), ("insert", 2, 2)] and got[1]["s"] is None


numbers = {"replace": 1, "insert": 2, "delete": 3}


def by_waves(a, b):
    """The path of edit_script, which walks through waves."""
    out, i = [], 0
    for op, sp, _ in editing.edit_script(a, b):
        out += [0] * (sp - i) + [numbers[op]]
        i = sp + (op != "insert")
    return out + [0] * (len(a) - i)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(short, short), min_size=1, max_size=40))
def test_paths_by_bit_vectors_are_those_of_scripts(pairs):
    got = editing.paths([a for a, _ in pairs], [b for _, b in pairs])
    assert [x.tolist() for x in got] == [by_waves(a, b) for a, b in pairs]


def test_paths_of_many_blocks_and_narrow_bands():
    draw = random.Random(3)
    text = lambda n, alphabet: "".join(draw.choices(alphabet, k=n))
    for copies in (1, 7):  # few pairs are walked back one by one, many together
        t = text(700, "ab é漢😀")
        cut, at = draw.randint(100, 250), draw.randint(0, 400)
        pairs = [(t[:at] + t[at + cut :], t), (t, t[:at] + t[at + cut :]), (t[cut:] + t[:cut], t), (text(500, "ab"), text(650, "ab")), (t[:64], t[:129]), ("", t), (t, ""), ("x" + t, t + "y")]
        want = [by_waves(a, b) for a, b in pairs]
        got = editing.paths(*zip(*(pairs * copies), strict=True))
        assert [x.tolist() for x in got] == want * copies
        codes = [[bitvectors.code_points(x) for x in side] for side in zip(*pairs[:4], strict=True)]
        for band in (1, 70, 150):
            assert [x.tolist() for x in bitvectors.paths(*codes, band)] == want[:4]


def test_pairs_beyond_the_bits_memory(monkeypatch):
    a, b = "the cat sat on the mat " * 6, "the bat sat at the mat, " * 6
    want = by_waves(a, b)
    monkeypatch.setattr(bitvectors, "TRACE_BYTES", 100)
    assert editing.paths([a, "x"], [b, "y"])[0].tolist() == want


def test_alignment_does_not_hang_on_slices(monkeypatch):
    rows = [("cot", "cart"), ("", ""), ("abxc", "abc"), ("", "ab"), ("ab", "")]
    whole = editing.align_all(*zip(*rows, strict=True), [None] * 5, [None] * 5)
    assert whole == [editing.align(a, b) for a, b in rows] and whole[3] == ("^^", "ab", "^^", "WW") and whole[4] == ("ab", "@@", "WW", "@@")
    monkeypatch.setattr(editing, "SLICE", 4)
    assert list(editing._slices([7, 0, 7, 2, 2])) == [(0, 1), (1, 2), (2, 3), (3, 5)] and list(editing._slices([])) == [(0, 0)]


def test_cutting_by_filled_types_at_once(spark):
    """The same as by arrays of one character each, which words_only spent more than half of its time on."""
    draw = random.Random(8)
    types = ["".join(draw.choices("@@W Iw", k=draw.choice([0, 1, 2, 3, 12]))) for _ in range(300)]
    data = [(k, t, "".join(draw.choices("aé漢😀\n", k=len(t) + (k % 29 == 3))), None if k % 31 == 5 else "x" * len(t)) for k, t in enumerate(types)] + [(999, None, "a", "b")]
    for some in (data, [r for r in data if r[1] and r[3] and len(r[1]) == len(r[2])]):
        df = spark.createDataFrame(some, "k int, t string, a string, b string").withColumn("s", X.kept_by_filled_types(F.col("t"), F.col("a"), F.col("b")))
        plain = lambda c: X.keep_by_type(F.col(c), X.fill_types(F.col("t")))
        got = df.select("s.c0", "s.c1", plain("a"), plain("b")).collect()
        assert all(r[0] == r[2] and r[1] == r[3] for r in got) and any(r[0] for r in got)
