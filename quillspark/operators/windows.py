"""Windows over texts: sliding, disjoint and n-gram windows, votes, vocabularies and codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import ranked

PAD, START, END, FIRST = 0, 1, 2, 3
UNKNOWN = "<UNK>"


#: Texts are cut into pieces of about so many characters before windows are taken, since a window's place in a string is found by counting from its start.
PIECE = 128


def pieces(text: Column, size: int, after: int) -> Column:
    """The text in pieces of size characters, each with its number, and up to after characters that follow it: one pass, whatever the text's length. An empty text is one empty piece."""
    pattern = rf"(?s)(.{{1,{size}}})(?=(.{{0,{after}}}))"
    one = lambda group, name: F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias(name)
    empty = F.array(F.struct(F.lit("").alias("own"), F.lit("").alias("next")))
    return F.when(F.length(text) == 0, empty).otherwise(F.arrays_zip(one(1, "own"), one(2, "next")))


def windows(df: DataFrame, text: str, kind: str, size: int, *others: str) -> DataFrame:
    """A row for each window: start, and the window of the text and of each other column (equally long texts) there.

    sliding: every place of the text and the place after it, the last windows being shorter. disjoint: side by side, the last one shorter,
    none of an empty text. full: every place where a window fits; a text that is no longer than a window has one. Null texts have none.

    Work is proportional to a text's length: windows are cut from pieces of a bounded size, which have size - 1 characters of the next one.
    """
    step = size if kind == "disjoint" else max(PIECE, size)
    columns = (text, *others)
    cut = F.arrays_zip(*(pieces(F.col(c), step, 0 if kind == "disjoint" else size - 1).alias(f"c{k}") for k, c in enumerate(columns)))
    rows = df.withColumn("__length", F.length(text)).select("*", F.posexplode(cut).alias("__piece", "__cut"))
    part = lambda k, name: F.col("__cut").getField(f"c{k}").getField(name)
    if kind == "disjoint":
        rows = rows.filter(F.col("__length") > 0)
        return rows.withColumns({"start": F.col("__piece") * step, **{c: part(k, "own") for k, c in enumerate(columns)}}).drop("__length", "__piece", "__cut")
    begin, own = F.col("__piece") * step, F.length(part(0, "own"))
    if kind == "sliding":
        # the piece that ends the text has the place after it as well
        high = F.when(begin + own == F.col("__length"), own).otherwise(own - 1)
    elif kind == "full":
        high = F.least(F.greatest(own - 1, F.lit(0)), F.greatest(F.col("__length") - size, F.lit(0)) - begin)
    else:
        raise ValueError(kind)
    rows = rows.withColumn("__high", high).filter("__high >= 0").withColumns({f"__w{k}": F.concat(part(k, "own"), part(k, "next")) for k in range(len(columns))}).drop("__cut")
    rows = rows.withColumn("__at", F.explode(F.sequence(F.lit(0), F.col("__high"))))
    windowed = {c: F.substring(F.col(f"__w{k}"), F.col("__at") + 1, F.lit(size)) for k, c in enumerate(columns)}
    return rows.withColumns({"start": begin + F.col("__at"), **windowed}).drop("__length", "__piece", "__high", "__at", *(f"__w{k}" for k in range(len(columns))))


def weight(kind: str, j: Column, size: int) -> Column:
    """What a window's place j counts: the same everywhere (uniform), falling from the middle in a line (triangle) or as a bell; decimals, whose sums do not hang on their order."""
    middle = size // 2
    if kind == "uniform":
        value = F.lit(1.0)
    elif kind == "triangle":
        value = middle - 0.5 * F.abs(middle - j)
    elif kind == "bell":
        value = F.exp(-F.pow((middle - j) / F.lit(float(max(middle, 1))), F.lit(2.0)))
    else:
        raise ValueError(kind)
    return F.round(value, 6).cast("decimal(18,6)")


def votes(parts: DataFrame, key: str, length: str, window: str, kind: str, size: int) -> DataFrame:
    """key, pos, char, weight: what all windows together say for each place. Windows reach no further than the text."""
    chars = parts.select(key, length, "start", F.posexplode(F.split(window, "")).alias("j", "char"))
    at = chars.filter(F.col("char") != "").withColumn("pos", F.col("start") + F.col("j")).filter(F.col("pos") < F.col(length))
    return at.groupBy(key, "pos", "char").agg(F.sum(weight(kind, F.col("j"), size)).alias("weight"))


def elected(voted: DataFrame, key: str) -> DataFrame:
    """key and the text of each place's heaviest character; ties go to the least one.

    A maximum of (weight, order) replaces a sort: it is summed in every task before rows are dealt.
    """
    best = voted.groupBy(key, "pos").agg(F.max_by("char", F.struct("weight", (-F.ascii("char")).alias("o"))).alias("char"))
    return best.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "char"))), lambda x: x["char"]), "").alias("text"))


def stitched(chunks: DataFrame, key: str, at: str, text: str) -> DataFrame:
    """Chunk texts joined in order."""
    return chunks.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, text))), lambda x: x[text]), "").alias(text))


def stitched_to_sentinel(chunks: DataFrame, key: str, at: str, text: str, sentinel: str) -> DataFrame:
    """key, part (from 0), text: chunk texts joined in order up to each chunk that is the sentinel, which itself goes, as do the signs for start and end. What follows
    the last sentinel is no part: it has not been closed."""
    along = Window.partitionBy(key).orderBy(at)
    is_end = F.col(text) == sentinel
    ends = F.sum(F.when(is_end, 1).otherwise(0))
    marked = chunks.withColumn("part", (ends.over(along) - F.when(is_end, 1).otherwise(0)).cast("int")).withColumn("__ends", ends.over(Window.partitionBy(key)))
    plain = F.when(is_end, "").otherwise(F.regexp_replace(text, "<START>|<END>", ""))
    closed = marked.filter(F.col("part") < F.col("__ends")).select(key, "part", at, plain.alias(text))
    return closed.groupBy(key, "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, text))), lambda x: x[text]), "").alias(text))


def characters(df: DataFrame, text: str) -> DataFrame:
    """Every character of every text with its number of occurrences, counted in each text before rows are dealt."""
    one = df.select(F.explode(F.split(text, "")).alias("char")).filter(F.col("char") != "")
    return one.groupBy("char").agg(F.count(F.lit(1)).alias("n"))


def first_with_character(wins: DataFrame, key: str, start: str, window: str) -> DataFrame:
    """char, and key and start (whole numbers, starts below 2^32) of the first window with it.

    Both are one decimal, whose least one is found by hashing: a least pair would sort every window's characters in each task.
    """
    place = F.col(key).cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.col(start)
    chars = wins.select(place.alias("place"), F.explode(F.array_distinct(F.split(window, ""))).alias("char")).filter(F.col("char") != "")
    best = chars.groupBy("char").agg(F.min("place").alias("place")).withColumn("low", F.pmod("place", F.lit(1 << 32).cast("decimal(10,0)")))
    kinds = (wins.schema[key].dataType, wins.schema[start].dataType)
    return best.select("char", ((F.col("place") - F.col("low")) / F.lit(1 << 32).cast("decimal(10,0)")).cast(kinds[0]).alias(key), F.col("low").cast(kinds[1]).alias(start))


def vocabulary(df: DataFrame, text: str, *more: str) -> DataFrame:
    """char and idx: the characters in order, from 3 on, with those added and the sign for unknown ones."""
    added = df.sparkSession.createDataFrame([(c,) for c in (*more, UNKNOWN)], "char string")
    every = characters(df, text).select("char").union(added).distinct()
    return ranked(every, "char", column="idx").withColumn("idx", (F.col("idx") + FIRST).cast("int"))


class Index:
    """A vocabulary of characters as arrays of constants, which code points lead into: a look-up costs the same whatever the alphabet's size.

    The upper bits of a code point name a block of 256, the lower ones its place there; only blocks that the vocabulary uses are written out.
    The driver holds the vocabulary, which Unicode bounds.
    """

    def __init__(self, vocab: DataFrame):
        idx = {r["char"]: r["idx"] for r in vocab.collect()}
        self.unknown = idx.pop(UNKNOWN, None)
        blocks: dict[int, list[int]] = {}
        for char, i in idx.items():
            blocks.setdefault(ord(char) >> 8, [0] * 256)[ord(char) & 255] = i
        last = max(blocks, default=0)
        order = sorted(blocks)
        numbers = {b: k + 1 for k, b in enumerate(order)}
        ints = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<int>")
        # block 0 of the second array is for code points of blocks that the vocabulary lacks
        self._pages, self._last = ints(numbers.get(b, 0) for b in range(last + 1)), last
        self._places = ints([0] * 256 + [x for b in order for x in blocks[b]])
        self._chars, self._n = F.split(F.lit("".join(sorted(idx, key=idx.get))), ""), len(idx)

    def of(self, char: Column) -> Column:
        """The number of a character, null if the vocabulary lacks it."""
        code = F.ascii(char)
        page = F.shiftright(code, 8)
        block = F.when(page <= self._last, F.get(self._pages, page)).otherwise(0)
        found = F.get(self._places, block * 256 + code.bitwiseAND(255))
        return F.when(found > 0, found)

    def char(self, number: Column) -> Column:
        """The character of a number, the sign for unknown ones for theirs; null for a number that is none."""
        # numbers are consecutive but for the unknown sign's
        place = number - FIRST - (F.when(number > self.unknown, 1).otherwise(0) if self.unknown is not None else 0)
        plain = F.when((place >= 0) & (place < self._n), F.get(self._chars, place))
        return F.when(number == self.unknown, UNKNOWN).otherwise(plain) if self.unknown is not None else plain


def encode(text: Column, index: Index, size: int | None = None) -> Column:
    """START, the characters' numbers (unknown ones as UNKNOWN's) and END; with a size cut to it or padded."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    ids = F.concat(F.array(F.lit(START)), F.transform(chars, lambda c: F.coalesce(index.of(c), F.lit(index.unknown).cast("int"))), F.array(F.lit(END)))
    return ids if size is None else F.slice(F.concat(ids, F.array_repeat(F.lit(PAD), size)), 1, size)


def decode(ids: Column, index: Index) -> Column:
    """The text of the numbers, without padding, START and END."""
    return F.array_join(F.transform(F.filter(ids, lambda i: i >= FIRST), index.char), "")


def replace_unknown(text: Column, index: Index) -> Column:
    """Characters that the vocabulary lacks become blanks."""
    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.when(index.of(c).isNotNull(), c).otherwise(" ")), "")
