"""License scans by diagonal voting, with DataFrame functions only.

Every place of every document gives one row with the word there, the next one and a hash of the four that begin there. These rows are
joined with the places of the templates' k-grams: short phrases by their word pairs, whole notices by their runs of four words. A match at
document word p and template word q votes for the diagonal p - q; votes are summed by diagonal, and each diagonal is merged with those that
are DRIFT above it at most (words put in; words left out are seen from the lower diagonal). The span is verified in the document's order: its
longest sequence of matches that goes on in the document and in the template must hold enough of the template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fold_ascii, fresh, text_or_empty

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases and the labels that they give.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Sentences of public license notices, and the labels that they give.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability": "mit",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis": "apache",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu": "gpl",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty": "gpl",
    "this work is licensed under a creative commons attribution": "cc-by",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
}
NOTICE_K = 4
#: A span's diagonals are this far apart at most: so many words may be put in or left out in all.
DRIFT = 6
#: Least part of a notice's k-grams that a span holds in order.
COVER = 0.6


def _run_hash(words: list[Column]) -> Column:
    return F.xxhash64(*words)


def templates(spark: SparkSession) -> DataFrame:
    """A row for each k-gram of each template: its number, phrase or notice, label, k-grams in all, place, first two words, and of notices the hash of all four."""
    rows = []
    for no, (text, label) in enumerate([*PHRASES.items(), *NOTICES.items()]):
        words, k = text.split(" "), 2 if text in PHRASES else NOTICE_K
        n = len(words) - k + 1
        rows += [(no, text in PHRASES, label, n, q, *words[q : q + 2], words[q : q + 4] if k > 2 else None) for q in range(n)]
    frame = spark.createDataFrame(rows, "template int, phrase boolean, label string, grams int, place int, first string, second string, run array<string>")
    run = _run_hash([F.col("run")[i] for i in range(NOTICE_K)])
    return frame.withColumn("run", F.when(F.col("run").isNotNull(), run))


def word_rows(words: Column) -> Column:
    """An array with an entry for each place: the word, the next one (null at the end), and the hash of the four from there (null where fewer are left)."""
    n = F.size(words)

    def entry(i: Column) -> Column:
        at = lambda d: F.try_element_at(words, i + d)
        return F.struct(at(0).alias("first"), at(1).alias("second"), F.when(i + NOTICE_K - 1 <= n, _run_hash([at(d) for d in range(NOTICE_K)])).alias("run"))

    return F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), entry)).otherwise(F.array().cast("array<struct<first:string,second:string,run:bigint>>"))


def in_order(span: str, grams: str) -> Column:
    """How many matches of a span follow each other in the document and in the template: for each template place the longest sequence that ends
    there, matches taken in the document's order. Of matches at one document place the later template place comes first, so that they do not follow each other."""
    match = lambda d, q: F.struct((d + q).alias("p"), (-q).alias("back"))
    matches = F.array_sort(F.flatten(F.transform(span, lambda x: F.transform(x["places"], lambda q: match(x["diagonal"], q)))))

    def step(best: Column, m: Column) -> Column:
        q = -m["back"]
        longer = 1 + F.coalesce(F.array_max(F.slice(best, F.lit(1), q)), F.lit(0))
        return F.transform(best, lambda b, k: F.when(k == q, F.greatest(b, longer)).otherwise(b))

    return F.array_max(F.aggregate(matches, F.array_repeat(F.lit(0), F.col(grams)), step))


def scan(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are runs of ASCII letters (A-Z lower-cased), digits and other code points above 127. n_base counts the places of PHRASES; labels
    adds those of verified notices; the score is 1 with a base place, else the largest part of a notice found in a span (0 to 1). A null
    text counts as empty: no words, empty labels. Repeated rows and null doc_ids each give a row; other columns are dropped; an empty
    table gives no row. Rows of one document meet in one task, a document's worth of matches at most; nothing else is grouped.
    """
    spark = docs.sparkSession
    known = templates(spark)
    words = F.regexp_extract_all(fold_ascii(text_or_empty("text")), F.lit(WORD), F.lit(0))
    listed = docs.select("doc_id", words.alias("words")).withColumn("row", F.monotonically_increasing_id())
    # the document's own row comes along as an entry with neither words nor hash: it keeps documents without a match
    own = F.array(F.struct(F.lit(None).cast("string").alias("first"), F.lit(None).cast("string").alias("second"), F.lit(None).cast("long").alias("run")))
    placed = listed.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), F.posexplode(F.concat(own, word_rows(F.col("words")))).alias("at", "gram"))
    placed = placed.select("row", "doc_id", "n_words", (F.col("at") - 1).alias("at"), "gram.first", "gram.second", "gram.run")
    header = spark.createDataFrame([(-1, None, None, None, None, None, None, None)], known.schema)
    table = known.unionByName(header).withColumnsRenamed({"first": "t_first", "second": "t_second", "run": "t_run"})
    # the templates are a few hundred rows that do not grow with the input
    same = (F.xxhash64("first", "second") == F.xxhash64("t_first", "t_second")) & F.col("first").eqNullSafe(F.col("t_first")) & F.col("second").eqNullSafe(F.col("t_second")) & (F.col("t_run").isNull() | (F.col("run") == F.col("t_run")))
    met = placed.join(F.broadcast(table), same & ((F.col("template") >= 0) | (F.col("at") < 0)))
    by_doc = met.select("row", "doc_id", "n_words", "template", "phrase", "label", "grams", "place", (F.col("at") - F.col("place")).alias("diagonal")).repartition("row")
    votes = by_doc.groupBy("row", "template", "diagonal").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.first("phrase").alias("phrase"), F.first("label").alias("label"), F.first("grams").alias("grams"), F.collect_set("place").alias("places")
    )
    near = Window.partitionBy("row", "template").orderBy("diagonal").rangeBetween(0, DRIFT)
    spans = votes.withColumn("span", F.when(~F.col("phrase"), F.collect_list(F.struct("diagonal", "places")).over(near)))
    spans = spans.withColumn("held", F.when(F.col("phrase"), F.size("places")).otherwise(in_order("span", "grams"))).withColumnRenamed("diagonal", "start")
    part = F.col("held") / F.col("grams")
    base = F.col("phrase") & (F.col("held") == F.col("grams"))
    noticed = ~F.col("phrase") & (part >= COVER)
    join = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return (
        spans.groupBy("row")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.first("n_words").alias("n_words"),
            F.count(F.when(base, 1)).alias("n_base"),
            F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
            F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
            join(F.when(base, F.col("label"))).alias("base_labels"),
            join(F.when(base | noticed, F.col("label"))).alias("labels"),
            F.greatest(F.max(F.when(base, 1.0).otherwise(0.0)), F.coalesce(F.max(F.when(~F.col("phrase"), part)), F.lit(0.0))).alias("score"),
        )
        .drop("row")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    """The same rows in DuckDB's SQL: words are unnested, k-grams compared as texts, and diagonals joined with those above them."""
    rows = []
    for no, (text, label) in enumerate([*PHRASES.items(), *NOTICES.items()]):
        words, k = text.split(" "), 2 if text in PHRASES else NOTICE_K
        n = len(words) - k + 1
        rows += [f"({no}, {text in PHRASES}, '{label}', {n}, {q}, '{' '.join(words[q : q + k])}', {k})" for q in range(n)]
    return rf"""
WITH t AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
g AS (SELECT * FROM (VALUES {", ".join(rows)}) AS v(template, phrase, label, grams, place, gram, k)),
p AS (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM t),
m AS (SELECT rid, template, phrase, label, grams, place, i - 1 - place AS diagonal FROM p JOIN g ON g.k = 2 AND g.gram = array_to_string(w[i:i + 1], ' ')
      UNION ALL SELECT rid, template, phrase, label, grams, place, i - 1 - place FROM p JOIN g ON g.k = {NOTICE_K} AND g.gram = array_to_string(w[i:i + {NOTICE_K - 1}], ' ')),
d AS (SELECT DISTINCT rid, template, phrase, label, grams, diagonal FROM m),
x AS (SELECT d.rid, d.template, d.diagonal, list([m.place::BIGINT] ORDER BY m.diagonal + m.place, m.place DESC) AS l FROM d JOIN (SELECT DISTINCT rid, template, diagonal, place FROM m WHERE NOT phrase) m
      ON m.rid = d.rid AND m.template = d.template AND m.diagonal BETWEEN d.diagonal AND d.diagonal + {DRIFT} GROUP BY ALL),
h AS (SELECT d.*, d.diagonal AS start, CASE WHEN phrase THEN (SELECT count(DISTINCT place) FROM m WHERE m.rid = d.rid AND m.template = d.template AND m.diagonal = d.diagonal) ELSE list_max(list_reduce(
      list_concat([list_transform(range(grams), lambda k: 0::BIGINT)], l),
      lambda best, e: list_transform(range(grams), lambda k: CASE WHEN k = e[1] THEN greatest(best[k + 1], 1 + coalesce(list_max(best[1:k]), 0)) ELSE best[k + 1] END))) END AS held
      FROM d LEFT JOIN x ON x.rid = d.rid AND x.template = d.template AND x.diagonal = d.diagonal),
f AS (SELECT *, phrase AND held = grams AS base, NOT phrase AND held / grams >= {COVER}::DOUBLE AS noticed FROM h),
a AS (SELECT rid, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
      string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base OR noticed) AS labels, max(CASE WHEN base THEN 1.0::DOUBLE WHEN phrase THEN 0.0::DOUBLE ELSE held / grams END) AS score FROM f GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM t LEFT JOIN a ON a.rid = t.rid
"""


SQL = _sql()
