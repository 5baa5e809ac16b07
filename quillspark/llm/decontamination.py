"""Benchmark decontamination over a positional inverted index, with DataFrame functions only.

A posting says that a word stands at a place of a document with a certain word after it: the list of such a pair is an intersection of the
two words' lists, offset by one, that is made where the text is read. Of all postings those are stored whose pair a test needs, so that the
index follows what tests and documents share. A window of a test (ten words, nine pairs) is looked up from its rarest pair: windows that share
their rarest pair's place are one look-up, whose list meets the lists of the pairs around it by the offset that the window gives them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, fold_ascii, fresh, join_hot, small_enough, text_or_empty

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WIDTH = 10
#: Pairs (8 bytes each) and look-ups (some 250 bytes each) that are broadcast; more of them meet the postings in a shuffle.
BROADCAST_PAIRS, BROADCAST_LOOKUPS = 1_000_000, 50_000
#: The pair of a document's own row, which keeps documents without a posting.
OWN = 0


def words(name: str = "text") -> Column:
    """Words are runs of ASCII letters (A-Z lower-cased), digits and other code points above 127; null has none."""
    return F.regexp_extract_all(fold_ascii(text_or_empty(name)), F.lit(WORD), F.lit(0))


def pairs_of(words: Column, singles: bool) -> Column:
    """A 64-bit hash of each word with the next one, and if asked for of each word alone after them."""
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<bigint>"))
    return F.concat(pairs, F.transform(words, lambda a: F.xxhash64(a, F.lit(1)))) if singles else pairs


class Index:
    """The postings of documents for some tests.

    rows: row, doc_id, n_words of every document. postings: row, pair, pos for each place where a pair of the tests stands. tests: test (a
    number), pairs of each different word sequence among the tests (one word: that word alone). members: test, item_id.
    """

    def __init__(self, docs: DataFrame, benchmark: DataFrame, width: int, scratch: Scratch):
        self.width, self.scratch = width, scratch
        items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words().alias("w")).filter(F.size("w") > 0)
        # equal tests are looked up once
        own = F.when(F.size("w") > 1, pairs_of(F.col("w"), False)).otherwise(pairs_of(F.col("w"), True))
        items = scratch.stored(items.select("item_id", F.sha2(F.array_join("w", " "), 256).alias("key"), own.alias("pairs"), F.size("w").alias("n")), "items")
        texts = items.groupBy("key").agg(F.first("pairs").alias("pairs"), F.first("n").alias("n"), F.count(F.lit(1)).alias("items"))
        self.tests = scratch.stored(texts.withColumn("test", F.monotonically_increasing_id()), "tests")
        self.members = scratch.stored(join_hot(items.select("item_id", "key"), self.tests.select("key", "test", "items"), "key", "items", F.col("item_id")).select("test", "item_id"), "members")
        scratch.drop(items)
        self.singles = not self.tests.filter("n = 1").isEmpty()
        self.stored = scratch.stored(self._postings(docs), "postings")
        self.rows = self.stored.filter("pos < 0").select("row", "doc_id", "n_words")
        self.postings = self.stored.filter("pos >= 0").select("row", "pair", "pos")

    def _postings(self, docs: DataFrame) -> DataFrame:
        listed = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), words().alias("w"))
        n = F.size("w")
        every = F.concat(F.array(F.lit(OWN).cast("long")), pairs_of(F.col("w"), self.singles))
        placed = listed.select("row", "doc_id", n.cast("long").alias("n_words"), F.posexplode(every).alias("at", "pair"))
        # pairs come first, then single words, whose places are counted anew
        pos = F.when(F.col("at") < F.greatest(F.col("n_words"), F.lit(1)), F.col("at") - 1).otherwise(F.col("at") - F.greatest(F.col("n_words"), F.lit(1))).cast("int")
        wanted = self.tests.select(F.explode("pairs").alias("pair")).distinct()
        spark = docs.sparkSession
        wanted = wanted.union(spark.range(OWN, OWN + 1).select(F.col("id").alias("pair"))).distinct()
        if small_enough(wanted, BROADCAST_PAIRS):
            met = placed.join(F.broadcast(wanted), "pair")
        else:
            seen = placed.groupBy("pair").agg(F.count(F.lit(1)).alias("rows")).join(wanted, "pair")
            met = join_hot(placed, self.scratch.stored(seen, "seen-pairs"), "pair", "rows", F.struct("row", "at"))
        met = met.select("row", "pair", pos.alias("pos"), "doc_id", "n_words")
        own = F.col("pos") < 0
        return met.select("row", "pair", "pos", F.when(own, F.col("doc_id")).alias("doc_id"), F.when(own, F.col("n_words")).alias("n_words"))

    def lookups(self, anchors: int) -> DataFrame:
        """test, n (its words), size (pairs of a window), q (the place of a look-up's pair), pair, starts (the places of the windows that look it
        up), around (the pairs from size - 1 places before to as many after, null beyond the test's ends).

        Every window looks up its anchors rarest pairs, the first of equally rare ones; a pair that no document has gives no look-up, and
        without missing pairs its window none either.
        """
        longest = self.width - 1
        size = F.least(F.size("pairs"), F.lit(longest))
        counts = self.postings.groupBy("pair").agg(F.count(F.lit(1)).alias("df"))
        tests = self.tests.select("test", "n", size.alias("size"), F.size("pairs").alias("m"), F.posexplode("pairs").alias("q", "pair"))
        placed = tests.join(counts, "pair", "left").withColumn("df", F.coalesce("df", F.lit(0)))
        along = Window.partitionBy("test").orderBy("q")
        rows = placed.withColumn("window", F.collect_list(F.struct("df", "q")).over(along.rowsBetween(0, longest - 1)))
        rows = self.scratch.stored(rows.withColumn("beside", F.collect_list(F.struct("q", "pair")).over(along.rowsBetween(1 - longest, longest - 1))), "test-windows")
        rarest = F.slice(F.array_sort("window"), 1, anchors)
        windows = rows.filter(F.col("q") <= F.col("m") - F.col("size")).select("test", F.col("q").alias("start"), rarest.alias("rarest"))
        if anchors == 1:
            windows = windows.filter(F.col("rarest")[0]["df"] > 0)
        chosen = windows.select("test", "start", F.explode("rarest").alias("x")).filter("x.df > 0").groupBy("test", F.col("x.q").alias("q")).agg(F.array_sort(F.collect_list("start")).alias("starts"))
        at = lambda o: F.try_element_at(F.filter("beside", lambda x: x["q"] == F.col("q") + o), F.lit(1))["pair"]
        around = F.transform(F.sequence(F.lit(1 - longest), F.lit(longest - 1)), at)
        return rows.join(chosen, ["test", "q"]).select("test", "n", "size", "q", "pair", "starts", around.alias("around"))

    def found(self, slop: int = 0, missing: int = 0) -> DataFrame:
        """row, test, n, size, start (the window's place in the test), at (where it would begin in the document), held: the windows of which the
        document has all pairs but missing at most, each at most slop places from where the looked-up one says."""
        longest = self.width - 1
        lookups = self.scratch.stored(self.lookups(missing + 1), "lookups")
        small = small_enough(lookups, BROADCAST_LOOKUPS)
        wanted = lookups.select("pair").distinct()
        rows = self.postings.join(F.broadcast(wanted) if small else wanted, "pair", "left_semi").select("row").distinct()
        near = Window.partitionBy("row").orderBy("pos").rangeBetween(-(longest - 1) - slop, longest - 1 + slop)
        beside = self.postings.join(rows, "row", "left_semi").withColumn("near", F.collect_list(F.struct("pos", "pair")).over(near))
        met = beside.join(F.broadcast(lookups) if small else lookups, "pair")
        offset = lambda i: i - (longest - 1)
        there = F.transform("around", lambda p, i: F.exists("near", lambda e: (e["pair"] == p) & (F.abs(e["pos"] - F.col("pos") - offset(i)) <= slop)))
        flags = F.transform(there, lambda x: F.when(x, 1).otherwise(0))
        met = met.select("row", "test", "n", "size", "q", "pos", "starts", flags.alias("flags"))
        held = lambda s: F.aggregate(F.slice("flags", s - F.col("q") + longest, F.col("size")), F.lit(0), lambda a, x: a + x)
        windows = F.transform("starts", lambda s: F.struct(s.alias("start"), (F.col("pos") - F.col("q") + s).alias("at"), held(s).alias("held")))
        whole = F.filter(windows, lambda w: w["held"] >= F.col("size") - missing)
        return met.select("row", "test", "n", "size", whole.alias("windows")).filter(F.size("windows") > 0)


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A window is width consecutive words of an item, or the whole item where it is shorter; n_hit counts the document's words inside any place
    where a window stands, n_items the items that have such a window, items_sha256 digests their ids, sorted as texts and joined by commas.
    Null and empty texts have no words, and items without words no window. Repeated documents and null doc_ids each give a row; repeated
    item_ids count once, null ones not at all. Other columns are dropped; without documents there is no row, without items none is hit.
    Pairs of words are compared by 64-bit hashes, nine of which agree in a window.
    """
    scratch = Scratch(docs.sparkSession)
    index = Index(docs, benchmark, width, scratch)
    # a window covers one word more than it has pairs, a single word itself
    span = lambda w: F.struct(w["at"].alias("a"), (w["at"] + F.when(F.col("n") == 1, 0).otherwise(F.col("size"))).alias("z"))
    spans = index.found().select("row", "test", F.transform("windows", span).alias("spans"))
    by_test = spans.groupBy("row", "test").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
    by_row = by_test.groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.collect_list("test")).alias("tests"))
    start = F.struct(F.lit(-1).alias("z"), F.lit(0).alias("n"))
    step = lambda acc, s: F.struct(F.greatest(acc["z"], s["z"]).alias("z"), (acc["n"] + F.greatest(s["z"] - F.greatest(s["a"] - 1, acc["z"]), F.lit(0))).alias("n"))
    hit = by_row.select("row", F.aggregate("spans", start, step, lambda acc: acc["n"].cast("long")).alias("n_hit"), "tests", F.sha2(F.array_join("tests", ","), 256).alias("of"))
    hit = scratch.stored(hit, "hits")
    # documents with the same tests share their digest
    sets = hit.groupBy("of").agg(F.first("tests").alias("tests")).select("of", F.explode("tests").alias("test"))
    ids = sets.join(index.members, "test").filter("item_id IS NOT NULL").groupBy("of").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    told = scratch.stored(ids.select("of", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256")), "item-sets")
    few = small_enough(told)
    named = hit.drop("tests").join(F.broadcast(told) if few else told, "of", "left")
    scratch.close(index.stored, hit, told)
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return index.rows.join(named, "row", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def near_matches(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, slop: int = 1, missing: int = 3) -> DataFrame:
    """doc_id, item_id, start, at, held: windows that a document has nearly. A window is looked up from its missing + 1 rarest pairs of words;
    it counts where all its pairs but missing stand within slop places of where the looked-up pair says. start is the window's place in the
    item and at where it would begin in the document (below 0 where its beginning is cut off); of several look-ups that say the same place
    the one that holds most pairs is given.

    Windows with missing pairs or fewer are not looked for. Else as scan().
    """
    scratch = Scratch(docs.sparkSession)
    index = Index(docs, benchmark, width, scratch)
    rows = index.found(slop, missing).filter(F.col("size") > missing).select("row", "test", F.explode("windows").alias("w")).select("row", "test", "w.*")
    best = rows.groupBy("row", "test", "start", "at").agg(F.max("held").alias("held"))
    out = best.join(index.rows.select("row", "doc_id"), "row").join(index.members.filter("item_id IS NOT NULL").distinct(), "test")
    return out.select("doc_id", "item_id", "start", "at", "held")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = rf"""
WITH fold AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
items AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(len(w), {WIDTH}) AS k, array_to_string(w[i:i + least(len(w), {WIDTH}) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), {WIDTH}) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM wins),
places AS (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM fold, sizes WHERE len(w) >= k),
grams AS (SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM places),
met AS (SELECT rid, i, g.k, item_id FROM grams g JOIN wins USING (k, win)),
hits AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM met) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id COLLATE "binary")) AS items_sha256 FROM (SELECT DISTINCT rid, item_id FROM met WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM fold LEFT JOIN hits USING (rid) LEFT JOIN named USING (rid)
"""
