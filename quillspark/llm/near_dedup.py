"""MinHash near-dedup by an inverted join over signature coordinates.

Every document is posted under each (coordinate, value) pair of its signature. Two sets of similarity 0.8 agree in about 51 of 64
coordinates, and in fewer than MATCHES = 33 once in ten million pairs; a pair counts as candidate from MATCHES collisions on, as half of the
pairs of similarity 0.5 and one in thirty of 0.4 do. Postings are
skipped by a prefix: with its pairs sorted from rare to frequent, a document that has t pairs which others share is posted under the first
t - MATCHES + 1 only, since two documents with MATCHES common pairs have one of them in both prefixes. Frequent passages thus drop out of
the postings while no candidate is lost. Merging the lists says which pairs collide at all; their collisions in the skipped lists are
looked up in the two signatures, and pairs over the threshold are confirmed on full shingle sets.

Documents with equal sets are one class from the start. No step sends all pairs of a group, and none leaves out a pair that could be linked
without being in one component already:

1. In each list a hub, the member that shares most postings with others, meets all other members.
2. Lists of at most SHORT_LIST members that still hold several components send the pairs between different ones.
3. Longer such lists are cut into blocks: all members outside the largest component meet all members of a similar set size, by signatures
   alone; blocks with few likely pairs send them, the others check theirs on full sets in the task and send links only.

Full sets are never stored: the texts of documents in candidate pairs, few of all, are shingled again and sent to the tasks that compare them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytespans import ODD, mixed, span_hashes, steps_of, word_spans
from .common import Scratch, fresh, join_hot, small_enough, text_or_empty
from .components import components

COORDINATES, MATCHES = 64, 33
PER_CENT = 80
SHORT_LIST = 16
#: A hub meets about so many members in a task, and blocks hold about so many; fewer where sets are large.
MEET, BLOCK, BLOCK_ELEMENTS = 64, 512, 2_000_000
#: Blocks with more likely pairs than this for each of their rows compare them where they are.
DENSE = 4
#: Rows of ids (16 bytes), and rows and places of sets that are wanted (PLACE_BYTES each), that are broadcast; longer lists meet their texts in a shuffle.
BROADCAST_IDS, BROADCAST_WANTED, PLACE_BYTES = 500_000, 32_000_000, 128

_GAPS = np.zeros(256, dtype=bool)
_GAPS[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_RNG = np.random.default_rng(20_231)
_XOR, _TIMES = (_RNG.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) for _ in range(2))
_TIMES = _TIMES * np.uint64(2) + np.uint64(1)


def shingle_sets(raw: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' sorted distinct shingle hashes, one text after the other, and their offsets. A text with fewer words is one shingle; one without words has none."""
    raw = _FOLD[raw]
    begin, end, doc = word_spans(_GAPS[raw], at)
    words = span_hashes(raw, begin, end)
    n = len(at) - 1
    count = np.bincount(doc, minlength=n)
    starts = np.concatenate([[0], np.cumsum(count)])
    rolled = np.zeros(max(len(words) - width + 1, 0), dtype=np.uint64)
    for k in range(width):
        rolled = mixed(rolled * np.uint64(ODD) + words[k : k + len(rolled)])
    sets = []
    for d in range(n):
        a, c = starts[d], count[d]
        if c >= width:
            sets.append(np.unique(rolled[a : a + c - width + 1]))
        elif c:
            whole = np.uint64(c)
            for w in words[a : a + c]:
                whole = mixed(np.array([whole], dtype=np.uint64) * np.uint64(ODD) + w)[0]
            sets.append(np.array([whole], dtype=np.uint64))
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
    return np.concatenate([np.zeros(0, np.uint64), *sets]), np.cumsum([0, *map(len, sets)])


def set_keys(flat: np.ndarray, at: np.ndarray) -> list[bytes | None]:
    """128 bits of each set; null for the empty set."""
    full = np.flatnonzero(np.diff(at))
    out: list[bytes | None] = [None] * (len(at) - 1)
    if len(full):
        sums = np.stack([np.add.reduceat(mixed(flat ^ np.uint64(salt)), at[full]) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)], axis=1)
        raw = sums.astype("<u8").tobytes()
        for k, d in enumerate(full.tolist()):
            out[d] = raw[16 * k : 16 * k + 16]
    return out


def signatures(flat: np.ndarray, at: np.ndarray) -> pa.Array:
    """The least value of each coordinate's hash over each set, as lists; null for the empty set."""
    full = np.flatnonzero(np.diff(at))
    out = np.zeros((len(at) - 1, COORDINATES), dtype=np.uint64)
    if len(full):
        for k in range(COORDINATES):
            out[full, k] = np.minimum.reduceat((flat ^ _XOR[k]) * _TIMES[k], at[full])
    ends = np.arange(len(out) + 1, dtype=np.int32) * COORDINATES
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(out.view(np.int64).ravel()), mask=pa.array(np.diff(at) == 0))


def shortened(sets: list[np.ndarray]) -> np.ndarray:
    """15 bits of each value of the signatures of full sets."""
    flat, at = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    return np.stack([(np.minimum.reduceat((flat ^ _XOR[k]) * _TIMES[k], at) & np.uint64(0x7FFF)).astype(np.int16) for k in range(COORDINATES)], axis=1)


def _signed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, raw, at in steps_of(batch.column("text")):
            flat, cut = shingle_sets(raw, at, width)
            yield pa.RecordBatch.from_pydict({
                **{c: batch.column(c).slice(i, j - i) for c in ("row", "doc_id", "of_text")}, "n": pa.array(np.diff(cut), pa.int64()),
                "key": pa.array(set_keys(flat, cut), pa.binary()), "sig": signatures(flat, cut),
            })


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """node, elements and ts of texts whose set has the wanted key (another text with an equal hash has not), once a task."""
    seen: set[int] = set()
    for batch in batches:
        for i, j, raw, at in steps_of(batch.column("text")):
            flat, cut = shingle_sets(raw, at, width)
            met = []
            for k, (own, wanted, node) in enumerate(zip(set_keys(flat, cut), batch.column("key")[i:j].to_pylist(), batch.column("node")[i:j].to_pylist(), strict=True)):
                if own == wanted and node not in seen:
                    seen.add(node)
                    met.append(k)
            rows = batch.slice(i, j - i).take(pa.array(met, pa.int64()))
            yield pa.RecordBatch.from_pydict({"node": rows.column("node"), "elements": pa.array([flat[cut[k] : cut[k + 1]].astype("<u8").tobytes() for k in met], pa.binary()), "ts": rows.column("ts")})


def similar_sizes(n: Column, m: Column, per_cent: int) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * per_cent


def agreeing(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))


def unpacked(sets: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(e, "<u8") for e in sets.to_pylist()]


def shared_with(hub: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each sorted set has in common with the hub's sorted set."""
    if not sets:
        return np.zeros(0, np.int64)
    flat = np.concatenate(sets)
    hit = hub[np.minimum(np.searchsorted(hub, flat), len(hub) - 1)] == flat
    return np.add.reduceat(hit.astype(np.int64), np.cumsum([0, *map(len, sets[:-1])]))


def similar(both: np.ndarray, n: np.ndarray, m: np.ndarray, per_cent: int) -> np.ndarray:
    return both * 100 >= (n + m - both) * per_cent


LINK = "a long, b long"


def links(a: np.ndarray, b: np.ndarray) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


class Search:
    """The links of one set of documents. Classes are rows of node (a row number of one of its documents), key, n, sig and short (15 bits of each value of sig)."""

    def __init__(self, docs: DataFrame, width: int, per_cent: int, scratch: Scratch):
        self.width, self.per_cent, self.scratch = width, per_cent, scratch
        text = text_or_empty("text")
        self.texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("of_text"))
        rows = self.texts.withColumn("row", F.monotonically_increasing_id())
        signed = scratch.stored(rows.mapInArrow(lambda b: _signed(b, width), "row long, doc_id long, of_text long, n long, key binary, sig array<long>"), "signatures")
        full = signed.filter("n > 0").groupBy("key")
        # what a class has more than one of is the same for all, but for texts that differ in case or white space
        best = full.agg(F.min_by(F.struct("n", "sig", "of_text", F.col("doc_id").alias("of_doc")), "row").alias("one"), F.min("row").alias("node"), F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
        short = F.transform("one.sig", lambda v: v.bitwiseAND(0x7FFF).cast("short")).alias("short")
        self.classes = scratch.stored(best.select("node", "key", "doc_id", "copies", "one.*", short), "classes")
        self.rows = scratch.stored(signed.select("row", "doc_id", "of_text", "n", "key"), "rows")
        scratch.drop(signed)

    def postings(self) -> DataFrame:
        """token, node, n, posted (length of the token's list) and the list's hub with its n, for the tokens in each class's prefix."""
        stored, drop = self.scratch.stored, self.scratch.drop
        token = F.posexplode("sig").alias("at", "value")
        tokens = self.classes.select("node", "n", token).select("node", "n", F.xxhash64("at", "value").alias("token"))
        shared = stored(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("posted")).filter("posted > 1"), "shared-tokens")
        met = join_hot(tokens, shared, "token", "posted", F.col("node")).groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("posted", "token"))).alias("tokens"))
        met = met.filter(F.size("tokens") >= MATCHES).withColumn("weight", F.aggregate("tokens", F.lit(0).cast("long"), lambda w, t: w + t["posted"]))
        prefix = met.select("node", "n", "weight", F.explode(F.slice("tokens", F.lit(1), F.size("tokens") - MATCHES + 1)).alias("t"))
        prefix = stored(prefix.select("node", "n", "weight", "t.token"), "prefix")
        hub = F.max_by(F.struct(F.col("node").alias("hub"), F.col("n").alias("hub_n")), F.struct("weight", -F.col("node"))).alias("h")
        lists = prefix.groupBy("token").agg(F.count(F.lit(1)).alias("posted"), hub).filter("posted > 1").select("token", "posted", "h.*")
        lists = stored(lists, "lists")
        out = stored(join_hot(prefix.drop("weight"), lists, "token", "posted", F.col("node")), "postings")
        drop(shared, prefix, lists)
        return out

    def with_sets(self, roles: DataFrame) -> DataFrame:
        """t, node, elements for each of the roles (node, t: a struct that says where the node's set is to go). Sets (packed sorted hashes) are made
        again from one text of the class; the texts of other documents are neither shingled nor sent."""
        targets = roles.groupBy("node").agg(F.collect_list("t").alias("ts"))
        about = self.classes.select("node", "key", F.col("of_text").alias("of"), F.col("of_doc").alias("doc"))
        wanted = self.scratch.stored(targets.join(about, "node"), "wanted")
        texts, width = self.texts, self.width
        # a set may go to many places, so that what a row holds is counted, not rows alone
        places = wanted.agg(F.sum(F.size("ts") + 1)).first()[0] or 0
        few = places * PLACE_BYTES <= BROADCAST_WANTED
        ids = wanted.select(F.col("of").alias("known"))
        if not few and small_enough(ids, BROADCAST_IDS):
            texts = texts.join(F.broadcast(ids), F.col("of_text") == F.col("known"), "left_semi")
        same = (F.col("of_text") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("doc"))
        met = texts.join(F.broadcast(wanted) if few else wanted, same).select("node", "key", "text", "ts")
        made = met.mapInArrow(lambda b: _sets(b, width), T.StructType().add("node", "long").add("elements", "binary").add("ts", wanted.schema["ts"].dataType))
        return made.select(F.explode("ts").alias("t"), "node", "elements")

    def likely(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b and more) whose signatures agree often enough. Only 15 bits of each value are sent: a pair too many in that is refuted on full sets."""
        short = self.classes.select(F.col("node").alias("b"), F.col("short").alias("b_short"))
        hubs = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("rows")).join(self.classes.select(F.col("node").alias("a"), F.col("short").alias("a_short")), "a")
        both = join_hot(pairs.join(short, "b"), self.scratch.stored(hubs, "hubs"), "a", "rows", F.col("b"))
        return both.filter(agreeing(F.col("a_short"), F.col("b_short")) >= MATCHES).drop("a_short", "b_short", "rows")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose full sets are similar enough.

        pairs: a, b, an and most, a bound of the number of pairs with that a. A task holds the set of one a and those of about MEET b,
        fewer where they are large.
        """
        per_cent = self.per_cent
        parts = F.ceil(F.col("most") / MEET * (1 + F.col("an") / 20_000)).cast("long")
        dealt = pairs.select("a", F.pmod(F.xxhash64("b"), parts).cast("long").alias("part"), "b")
        role = F.struct(F.col("a").alias("hub"), "part").alias("t")
        roles = dealt.select(F.col("b").alias("node"), role).union(dealt.select("a", role).distinct())

        def meet(rows: pa.Table) -> pa.Table:
            node, hub = rows["node"].to_numpy(), rows["hub"][0].as_py()
            own = np.flatnonzero(node == hub)
            b, at = np.unique(node[node != hub], return_index=True)
            if not len(own) or not len(b):
                return links(np.zeros(0), np.zeros(0))
            each = unpacked(rows["elements"].take(pa.array(np.flatnonzero(node != hub)[at])))
            hub_set = np.frombuffer(rows["elements"][int(own[0])].as_py(), "<u8")
            good = similar(shared_with(hub_set, each), np.array([len(x) for x in each]), len(hub_set), per_cent)
            return links(np.full(good.sum(), hub), b[good])

        return self.with_sets(roles).select("t.*", "node", "elements").groupBy("hub", "part").applyInArrow(meet, LINK)

    def labels(self) -> DataFrame:
        """node, label for every class that is linked with another."""
        stored, drop = self.scratch.stored, self.scratch.drop
        postings = self.postings()
        wanted = (F.col("node") != F.col("hub")) & similar_sizes(F.col("n"), F.col("hub_n"), self.per_cent)
        pairs = stored(postings.filter(wanted).groupBy(F.col("hub").alias("a"), F.col("node").alias("b")).agg(F.any_value("hub_n").alias("an"), F.max("posted").alias("most")), "hub-pairs")
        met = stored(self.likely(pairs), "hub-candidates")
        found = stored(self.confirmed(met), "hub-links")
        labels = components(found, self.scratch)
        drop(pairs, met, found)
        known = stored(self.open_lists(postings, labels), "open-lists")
        drop(postings)
        pairs = stored(self.short_pairs(known.filter(F.col("posted") <= SHORT_LIST)), "short-pairs")
        if not pairs.isEmpty():
            labels = self.merged(labels, stored(self.confirmed(pairs), "short-links"))
        long = known.filter(F.col("posted") > SHORT_LIST).drop("label")
        still = stored(self.open_lists(long, labels), "open-long-lists")
        if not still.isEmpty():
            labels = self.merged(labels, self.block_links(still))
        drop(pairs, known, still)
        return labels

    def merged(self, labels: DataFrame, found: DataFrame) -> DataFrame:
        """The labels after more links."""
        out = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(found), self.scratch)
        self.scratch.drop(labels, found)
        return out

    def open_lists(self, postings: DataFrame, labels: DataFrame) -> DataFrame:
        """The postings, with their labels, of lists that hold several components."""
        known = postings.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        spread = known.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("rows")).filter("low <> high")
        return join_hot(known, self.scratch.stored(spread.select("token", "rows"), "open-tokens"), "token", "rows", F.col("node")).drop("rows")

    def short_pairs(self, members: DataFrame) -> DataFrame:
        """The pairs of short lists with different labels that the hubs' round has not looked at, with as many collisions as a candidate has."""
        short = self.classes.select("node", "short")
        rows = members.filter(F.col("node") != F.col("hub")).select("token", "node", "n", "label").join(short, "node")
        lists = rows.groupBy("token").agg(F.array_sort(F.collect_list(F.struct("node", "n", "label", "short"))).alias("l"))
        fit = lambda x, y: (x["label"] != y["label"]) & similar_sizes(x["n"], y["n"], self.per_cent) & (agreeing(x["short"], y["short"]) >= MATCHES)
        pair = lambda x, y: F.struct(x["node"].alias("a"), y["node"].alias("b"), x["n"].alias("an"))
        pairs = F.flatten(F.transform("l", lambda x, i: F.transform(F.filter(F.slice("l", i + 2, SHORT_LIST), lambda y: fit(x, y)), lambda y: pair(x, y))))
        # a class is in at most COORDINATES lists
        return lists.select(F.explode(pairs).alias("p")).select("p.*").distinct().withColumn("most", F.lit(COORDINATES * SHORT_LIST))

    def block_links(self, members: DataFrame) -> DataFrame:
        """Links between members of long lists that hold several components. members: token, node, n, hub (its list's), label.

        Lists that share members are one cluster. Its members outside the cluster's largest component meet its members of a similar set
        size, block by block (cells), by signatures. Where a cell has few likely pairs it sends them; else it is dense, and checks them on
        full sets, likeliest first, and leaves out those that are in one component by then, so that it gives fewer links than it has
        members. Members of the largest component are sent once for each block of the others.
        """
        stored, drop, per_cent = self.scratch.stored, self.scratch.drop, self.per_cent
        clusters = components(members.filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")), self.scratch)
        each = members.groupBy("node").agg(F.min("label").alias("label"), F.min("n").alias("n"))
        rows = stored(clusters.select("node", F.col("label").alias("cluster")).join(each, "node"), "cluster-members")
        labels = rows.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("k"))
        most = labels.groupBy("cluster").agg(F.max(F.struct("k", "label"))["label"].alias("most"), F.sum("k").alias("rows"))
        # sets that are similar enough are in one size class or in neighbouring ones
        size = F.floor(F.log(F.col("n")) / F.log(F.lit(101.0 / per_cent))).cast("int")
        known = stored(join_hot(rows, stored(most, "clusters"), "cluster", "rows", F.col("node")).withColumn("size", size), "sized-members")
        left = known.filter("label <> most")
        right = known.withColumn("size", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)))
        cut = F.greatest(F.lit(1), F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_ELEMENTS))).cast("int")
        grid = left.groupBy("cluster", "size").agg(cut.alias("nl")).join(right.groupBy("cluster", "size").agg(cut.alias("nm"), F.count(F.lit(1)).alias("rows")), ["cluster", "size"])
        grid = stored(grid.select(F.struct("cluster", "size").alias("of"), "nl", "nm", "rows"), "grid")
        at = lambda salt, k: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(k)).cast("int")
        every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
        of = F.struct("cluster", "size").alias("of")
        left = join_hot(left.select(of, "node", "label", "n"), grid, "of", "rows", F.col("node")).select("of.*", at(1, "nl").alias("i"), every("nm").alias("j"), F.lit(True).alias("one"), "node", "label", "n")
        right = join_hot(right.select(of, "node", "label", "n"), grid, "of", "rows", F.col("node")).select("of.*", every("nl").alias("i"), at(2, "nm").alias("j"), F.lit(False).alias("one"), "node", "label", "n")
        dealt = stored(left.unionByName(right), "cells")
        cell = ("cluster", "size", "i", "j")

        def pairs_of(rows: pa.Table, short: np.ndarray) -> tuple[np.ndarray, ...]:
            """Collisions and rows of the likely pairs of a cell."""
            one, label, n = rows["one"].to_numpy(zero_copy_only=False), rows["label"].to_numpy(), rows["n"].to_numpy()
            x_rows, y_rows = np.flatnonzero(one), np.flatnonzero(~one)
            found = [np.zeros((0, 3), dtype=np.int64)]
            for x in x_rows.tolist():
                y = y_rows[label[y_rows] != label[x]]
                y = y[np.minimum(n[y], n[x]) * 100 >= np.maximum(n[y], n[x]) * per_cent]
                agree = (short[y] == short[x]).sum(axis=1)
                found.append(np.stack([agree, np.full(len(y), x), y], axis=1)[agree >= MATCHES])
            return np.concatenate(found), label, n

        def by_signature(rows: pa.Table) -> pa.Table:
            found, _, n = pairs_of(rows, rows["short"].combine_chunks().flatten().to_numpy().reshape(-1, COORDINATES))
            node = rows["node"].to_numpy()
            dense = len(found) > DENSE * len(node)
            a, b, an = (np.zeros(int(dense), np.int64),) * 3 if dense else (node[found[:, 1]], node[found[:, 2]], n[found[:, 1]])
            keys = {c: pa.array([rows[c][0].as_py()] * len(a), rows.schema.field(c).type) for c in cell}
            return pa.table({**keys, "dense": pa.array(np.full(len(a), dense)), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "an": pa.array(an, pa.int64())})

        with_short = dealt.join(self.classes.select("node", "short"), "node")
        met = stored(with_short.groupBy(*cell).applyInArrow(by_signature, "cluster long, size int, i int, j int, dense boolean, a long, b long, an long"), "block-pairs")
        found = self.confirmed(met.filter("not dense").select("a", "b", "an").distinct().withColumn("most", F.lit(BLOCK)))
        dense = met.filter("dense").select(*cell)
        if not dense.isEmpty():
            inside = dealt.join(dense, list(cell), "left_semi")
            roles = inside.select("node", F.struct(*cell, "one", "label", "n").alias("t"))

            def by_sets(rows: pa.Table) -> pa.Table:
                node, sets = rows["node"].to_numpy(), unpacked(rows["elements"])
                found, label, n = pairs_of(rows, shortened(sets))
                parent = {x: x for x in label.tolist()}

                def find(x: int) -> int:
                    while parent[x] != x:
                        parent[x] = parent[parent[x]]
                        x = parent[x]
                    return x

                linked = []
                for _, x, y in found[np.argsort(-found[:, 0], kind="stable")].tolist():
                    p, q = find(int(label[x])), find(int(label[y]))
                    if p != q and similar(shared_with(sets[x], [sets[y]]), n[x], n[y], per_cent)[0]:
                        parent[max(p, q)] = min(p, q)
                        linked.append((node[x], node[y]))
                return links(np.array([a for a, _ in linked]), np.array([b for _, b in linked]))

            found = found.unionByName(self.with_sets(roles).select("t.*", "node", "elements").groupBy(*cell).applyInArrow(by_sets, LINK))
        out = stored(found, "block-links")
        drop(clusters, rows, known, grid, dealt, met)
        return out


def _components(docs: DataFrame, width: int, per_cent: int, scratch: Scratch) -> tuple[Search, DataFrame]:
    """The search, and its classes with their component: key, copies, label (a number of the component) and component_id (its least doc_id)."""
    search = Search(docs, width, per_cent, scratch)
    labels = search.labels()
    linked = scratch.stored(search.classes.select("node", "key", "doc_id", "copies").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "linked")
    least = scratch.stored(linked.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("rows")), "least")
    named = scratch.stored(join_hot(linked.drop("node", "doc_id"), least, "label", "rows", F.col("key")).select("key", "copies", "label", "component_id"), "class-components")
    return search, named


def near_duplicates(docs: DataFrame, width: int = 5, per_cent: int = PER_CENT) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id, kept.

    Words are runs without ASCII white space, A-Z lower-cased; a set is the distinct runs of width words, or the whole sequence where it
    is shorter. Sets with 100 * common >= per_cent * union are linked. component_id is the smallest doc_id that can be reached, kept
    whether it is the row's own. A null text counts as empty; empty texts are linked with nothing and keep their own doc_id. Repeated rows
    are in one component. A row with a null doc_id takes part; its component_id is null only if all in its component are, and then it is
    kept. Other columns are dropped; an empty table gives no row. Of the tables that the search writes to the shared folder only two
    narrow ones stay, which the result reads.
    """
    scratch = Scratch(docs.sparkSession)
    search, named = _components(docs, width, per_cent, scratch)
    full = join_hot(search.rows.filter("n > 0"), named.select("key", "copies", "component_id"), "key", "copies", F.col("row")).select("doc_id", "n", "component_id")
    every = full.unionByName(search.rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    scratch.close(search.rows, named)
    return every.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def dedup(docs: DataFrame, width: int = 5, per_cent: int = PER_CENT) -> DataFrame:
    """The documents that stay, with their columns: one of each component, and all without words.

    Rows are told apart by doc_id and text. The row with the smallest doc_id stays, a null one last; of several such rows the one whose text has
    the least hash, and of rows with that doc_id and text the one whose columns have the least hash. Only the doc_ids and text hashes of rows
    that go or are repeated are joined with the documents: no text shuffles while there are BROADCAST_IDS of them at most, but those of
    repeated rows.
    """
    scratch = Scratch(docs.sparkSession)
    search, named = _components(docs, width, per_cent, scratch)
    several = scratch.stored(named.groupBy("label").agg(F.sum("copies").alias("documents"), F.count(F.lit(1)).alias("classes")).filter("documents > 1"), "several")
    classes = join_hot(named.select("label", "key", "copies"), several.select("label", "classes"), "label", "classes", F.col("key")).select("key", "copies", "label")
    rows = join_hot(search.rows.filter("n > 0"), scratch.stored(classes, "several-classes"), "key", "copies", F.col("row"))
    each = scratch.stored(rows.groupBy("label", "doc_id", "of_text").agg(F.count(F.lit(1)).alias("times")), "told-apart")
    best = each.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "of_text")).alias("best"), F.count(F.lit(1)).alias("rows"))
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("of_text") == F.col("best.of_text"))
    of, text, again, copy = fresh(docs.columns, "of", "of_text", "again", "copy")
    marked = join_hot(each, scratch.stored(best, "best"), "label", "rows", F.col("of_text")).select(F.col("doc_id").alias(of), F.col("of_text").alias(text), F.when(stays, F.col("times") > 1).alias(again), (~stays).alias(copy))
    marked = scratch.stored(marked.filter(F.col(copy) | F.col(again)).select(of, text, F.coalesce(again, F.lit(False)).alias(again)), "marked")
    few = small_enough(marked, BROADCAST_IDS)
    scratch.close(marked)
    same = docs["doc_id"].cast("long").eqNullSafe(marked[of]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == marked[text])
    met = docs.join(F.broadcast(marked) if few else marked, same, "left")
    alone = met.filter(F.col(text).isNull()).select(*docs.columns)
    hashable = [F.col(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString()]
    one = met.filter(F.col(again)).groupBy(of, text).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*hashable)).alias(copy))
    return alone.unionByName(one.select(*(F.col(copy).getField(c).alias(c) for c in docs.columns)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=2)
