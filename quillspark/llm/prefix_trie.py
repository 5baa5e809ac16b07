"""A prefix trie of conversations by partition refinement.

Equal conversations are one sequence from the start. All sequences are one class; in each round an active class follows the turns that all its
members share, in one step, whatever their number (the common prefix of its least and its greatest member), and is split by the turn after
them. A class of one sequence retires: the rest of its turns is a chain. A class with its shared turns is a stretch of nodes; counts below a
node are folded back round by round, from the deepest classes to the root.

Turns are 16 bytes of a digest each, so that classes never move texts. The digests of the ids that end at a node are made from sorted pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, join_hot, text_or_empty

BLOCK, HEADS = 20, 4
WORD = r"[^\x20\x09-\x0D]+"
#: Ids in a piece of a digest's input.
PIECE = 4_096


def turn_key(role: Column, text: Column) -> Column:
    """128 bits that tell turns apart."""
    return F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, at (from 1, by turn, null first, then by digest), key, words and n (the conversation's turns)."""
    role, text = text_or_empty("role"), text_or_empty("text")
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_key(role, text).alias("key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    own = Window.partitionBy("conv_id")
    return rows.withColumn("at", F.row_number().over(own.orderBy(F.asc_nulls_first("turn"), "key"))).withColumn("n", F.count(F.lit(1)).over(own)).drop("turn")


def rebuilt(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, keys and sums (words up to each turn) of every conversation with its head: the first h turns of conversation c - c % BLOCK (of
    its original turns all if they are fewer, none if it is absent), then its own turns after the first h, h being crc32(c in decimal) % HEADS."""
    turns = scratch.stored(_turns(conversations), "turns")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    # a head's turns are few, whatever the conversation's length, and those of a block meet at one id in BLOCK
    heads = turns.filter(F.col("at") < HEADS).groupBy(F.col("conv_id").alias("of")).agg(F.array_sort(F.collect_list(F.struct("at", "key", "words"))).alias("head"))
    own = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "key", "words"))).alias("own"))
    both = own.withColumn("of", F.col("conv_id") - F.col("conv_id") % BLOCK).join(heads, "of", "left").withColumn("h", h.cast("int"))
    first = F.when(F.col("head").isNull(), F.slice("own", 1, 0)).otherwise(F.slice("head", F.lit(1), F.col("h")))
    rest = F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0)))
    rows = both.select("conv_id", F.concat(first, rest).alias("turns"))
    # running sums by turn: rows rather than a fold that would copy its array for every turn
    placed = rows.select("conv_id", F.posexplode_outer("turns").alias("at", "turn")).select("conv_id", "at", "turn.key", F.sum("turn.words").over(Window.partitionBy("conv_id").orderBy("at")).alias("sum"))
    listed = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "key", "sum")))).alias("l"))
    return listed.select("conv_id", F.transform("l", lambda x: x["key"]).alias("keys"), F.transform("l", lambda x: x["sum"]).alias("sums"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by (seq, conv_id): the ids of each sequence as texts joined by commas, PIECE at a time, with the first one."""

    def piece(seq: int, held: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"seq": pa.array([seq], pa.int64()), "first": pa.array([held[0]], pa.int64()), "ids": pa.array([",".join(map(str, held))], pa.string())})

    now, held = None, []
    for batch in batches:
        for seq, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held and (seq != now or len(held) == PIECE):
                yield piece(now, held)
                held = []
            now = seq
            held.append(conv)
    if held:
        yield piece(now, held)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces come in order: one digest a sequence, fed as they come, so that no list of ids is held."""
    now, digest = None, None
    out: list[tuple[int, str]] = []
    for batch in batches:
        for seq, ids in zip(batch.column("seq").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if seq != now:
                if digest:
                    out.append((now, digest.hexdigest()))
                now, digest = seq, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        if out:
            yield _digest_rows(out)
            out = []
    if digest:
        yield _digest_rows([(now, digest.hexdigest())])


def _digest_rows(rows: list[tuple[int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"seq": pa.array([a for a, _ in rows], pa.int64()), "ends_sha256": pa.array([b for _, b in rows], pa.string())})


def ends(members: DataFrame) -> DataFrame:
    """seq, ends_sha256: of the sequences' conv_ids in decimal, ascending and joined by commas. Ids are dealt by range, so that those of a
    frequent sequence are sorted and joined in many tasks; the digest has one order, so that one task reads the pieces, one row for PIECE ids."""
    dealt = members.repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    pieces = dealt.select("seq", "conv_id").mapInArrow(_pieces, "seq long, first long, ids string")
    return pieces.repartition("seq").sortWithinPartitions("seq", "first").mapInArrow(_digests, "seq long, ends_sha256 string")


def refine(sequences: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """The trie's stretches by round: a stretch is the class of the sequences with its turns.

    conv_id (the least member) and low (the depth of its first node) name it, parent and parent_low its parent; high is the depth of its
    last node, convs its members, n_seqs how many sequences they are, sums the words up to each turn of one of them, and end the sequence
    that has no turn after it, if any.
    """
    stored = scratch.stored
    active = sequences.select("seq", "copies", "keys", "sums", F.lit(None).cast("long").alias("parent"), F.lit(-1).alias("parent_low"), F.lit(0).alias("low"), F.lit(None).cast("binary").alias("turn"))
    rounds: list[DataFrame] = []
    while True:
        by = ("parent", "parent_low", "low", "turn")
        one = active.groupBy(*by).agg(F.min(F.struct("keys", "seq", "sums")).alias("lo"), F.max("keys").alias("hi"), F.min("seq").alias("conv_id"), F.sum("copies").alias("convs"), F.count(F.lit(1)).alias("n_seqs"))
        unlike = F.array_position(F.zip_with("lo.keys", "hi", lambda a, b: ~a.eqNullSafe(b)), True)
        high = F.when(unlike > 0, unlike - 1).otherwise(F.size("hi")).cast("int")
        classes = one.withColumn("high", high)
        classes = stored(classes.select(*by, "conv_id", "high", "convs", "n_seqs", F.slice("lo.sums", F.lit(1), F.col("high")).alias("sums"), F.when(F.size("lo.keys") == F.col("high"), F.col("lo.seq")).alias("end")), "trie-classes")
        rounds.append(classes)
        several = classes.filter("n_seqs > 1").select(F.struct(*(F.col(c) for c in by)).alias("of"), "conv_id", F.col("low").alias("first"), "high", "n_seqs")
        if several.isEmpty():
            return rounds
        members = active.withColumn("of", F.struct(*(F.col(c) for c in by))).select("of", "seq", "copies", "keys", "sums")
        met = join_hot(members, several, "of", "n_seqs", F.col("seq")).filter(F.size("keys") > F.col("high"))
        step = met.select("seq", "copies", "keys", "sums", F.col("conv_id").alias("parent"), F.col("first").alias("parent_low"), (F.col("high") + 1).alias("low"), F.try_element_at("keys", F.col("high") + 1).alias("turn"))
        before, active = active, stored(step, "trie-active")
        if len(rounds) > 1:
            scratch.drop(before)


def folded(rounds: list[DataFrame], scratch: Scratch) -> list[DataFrame]:
    """The stretches with children (of their last node), leaves and saved (the words below their last node that copies repeat)."""
    out: list[DataFrame] = []
    below = None
    for classes in reversed(rounds):
        if below is None:
            rows = classes.withColumns({"children": F.lit(0).cast("long"), "leaves": F.lit(1).cast("long"), "saved": F.lit(0).cast("long")})
        else:
            rows = classes.join(below, (classes["conv_id"] == below["up"]) & (classes["low"] == below["up_low"]), "left").drop("up", "up_low")
            rows = rows.withColumns({"children": F.coalesce("children", F.lit(0)), "leaves": F.coalesce("leaves", F.lit(1)), "saved": F.coalesce("saved", F.lit(0))})
        rows = scratch.stored(rows, "trie-folded")
        out.append(rows)
        own = (F.col("convs") - 1) * words_from(F.col("low"))
        below = rows.groupBy(F.col("parent").alias("up"), F.col("parent_low").alias("up_low")).agg(F.count(F.lit(1)).alias("children"), F.sum("leaves").alias("leaves"), F.sum(own + F.col("saved")).alias("saved"))
    return out


def words_from(depth: Column) -> Column:
    """The words of a stretch's turns from a depth to its last node; the root has no turn."""
    upto = lambda d: F.when(d > 0, F.try_element_at("sums", F.greatest(d, F.lit(1)))).otherwise(F.lit(0).cast("long"))
    return upto(F.col("high")) - upto(depth - 1)


def trie(conversations: DataFrame) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversations are ordered by turn, null first; rows of one turn by a digest of role and text. Null roles and texts are empty. Rows
    without a conv_id belong to no conversation and are left out. A node is a different sequence of first turns (role, text); conversations
    without turns are members of the root. Repeated rows are turns of their own; other columns are dropped; without conversations there is
    no node. A round takes a class over all turns that its members share, so that there are as many rounds as a path has branches.

    A conversation's digests, 24 bytes a turn, meet in one task, and so do the pieces of the ids that end at one node.
    """
    scratch = Scratch(conversations.sparkSession)
    convs = scratch.stored(rebuilt(conversations, scratch).withColumn("key", F.sha2(F.concat_ws("", F.transform("keys", F.hex)), 256)), "rebuilt")
    groups = convs.groupBy("key").agg(F.min("conv_id").alias("seq"), F.count(F.lit(1)).alias("copies"), F.first("keys").alias("keys"), F.first("sums").alias("sums"))
    groups = scratch.stored(groups, "sequences")
    members = join_hot(convs.select("key", "conv_id"), groups.select("key", "seq", "copies"), "key", "copies", F.col("conv_id"))
    digests = scratch.stored(ends(members.select("seq", "conv_id")), "ends")
    rounds = folded(refine(groups, scratch), scratch)
    scratch.close(digests, *rounds)
    at = F.explode(F.sequence("low", "high")).alias("depth")
    out = None
    for rows in rounds:
        nodes = rows.select("*", at)
        last = F.col("depth") == F.col("high")
        nodes = nodes.select(
            "conv_id", F.col("depth").cast("long").alias("depth"), F.when(F.col("depth") > F.col("low"), F.col("conv_id")).otherwise(F.col("parent")).alias("parent_conv_id"), F.col("convs").alias("n_convs"),
            F.when(last, F.col("children")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
            ((F.col("convs") - 1) * words_from(F.col("depth")) + F.col("saved")).alias("saved_tokens"), F.when(last, F.col("end")).alias("end"),
        )
        out = nodes if out is None else out.unionByName(nodes)
    named = out.join(digests, out["end"] == digests["seq"], "left")
    return named.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: crc32 of the decimal digits, a bit at a time.
_BITS = "list_concat([4294967295::BIGINT], flatten(list_transform(string_split(c::VARCHAR, ''), lambda d: list_transform(range(8), lambda k: (ord(d)::BIGINT >> k::INTEGER) & 1))))"
_CRC = f"xor(list_reduce({_BITS}, lambda s, b: xor(s >> 1, 3988292384 * (xor(s, b) & 1))), 4294967295)"
SQL = rf"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS i,
  length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '') AS turn, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS words FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, {_CRC} % {HEADS} AS h FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT ids.c, t.i, t.turn, t.words FROM ids JOIN t ON t.c = ids.c - ids.c % {BLOCK} AND t.i <= h UNION ALL SELECT ids.c, t.i, t.turn, t.words FROM ids JOIN t ON t.c = ids.c AND t.i > h),
l AS (SELECT c, coalesce(list(sha256(turn) ORDER BY i) FILTER (turn IS NOT NULL), []) AS keys, coalesce(list(words ORDER BY i) FILTER (turn IS NOT NULL), []) AS words FROM ids LEFT JOIN r USING (c) GROUP BY c),
m AS (SELECT c, d, array_to_string(keys[1:d], '') AS node, array_to_string(keys[1:d - 1], '') AS up, CASE WHEN d = 0 THEN 0 ELSE words[d] END AS words, d = len(keys) AS ends FROM (SELECT *, unnest(range(len(keys) + 1)) AS d FROM l)),
n AS (SELECT node, any_value(up) AS up, d, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY node, d),
k AS (SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM n q WHERE q.d = n.d + 1 AND q.up = n.node) AS n_children FROM n LEFT JOIN n p ON p.node = n.up AND p.d = n.d - 1 AND n.d > 0)
SELECT a.conv_id, a.d AS depth, a.parent_conv_id, a.n_convs, a.n_children, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.words)::BIGINT AS saved_tokens, a.ends_sha256
FROM k a JOIN k b ON b.d >= a.d AND starts_with(b.node, a.node) GROUP BY a.conv_id, a.d, a.parent_conv_id, a.n_convs, a.n_children, a.ends_sha256
"""
