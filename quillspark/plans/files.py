"""Queries that write to the shared folder and read back through the sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import growth, marks
from ..operators import relational as R
from ..sources import readers, sinks
from ..sources.lookup import KeyStore, RowStore
from ..storage import scratch_path
from ..streaming import live
from ..streaming.ledger import Ledger, append_stream
from .inputs import rated, table
from .registry import query


#: Folders that checkpoints of orders are written to.
CHECKPOINTS = 64


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_path(spark, name)}/{name}"


@query("SELECT item_id::VARCHAR AS item_id, text, 'comma' AS kind FROM benchmark UNION ALL SELECT item_id::VARCHAR, text, 'semicolon' FROM benchmark")
def csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several CSV files read by a glob, and one with semicolons: texts with quotes and line ends come back as they were, numbers as texts."""
    items, where = table(spark, sf_dir, "benchmark").select("item_id", "text"), _folder(spark, "csv")
    for k in range(3):
        sinks.write_csv(items.filter(F.col("item_id") % 3 == k), f"{where}/comma-{k}")
    sinks.write_csv(items, f"{where}/semicolon", sep=";")
    comma = readers.csv(spark, f"{where}/comma-*", ["item_id", "text"]).withColumn("kind", F.lit("comma"))
    return comma.unionByName(readers.csv(spark, f"{where}/semicolon", ["item_id", "text"], sep=";").withColumn("kind", F.lit("semicolon")))


@query("""WITH r AS (SELECT strftime(o_orderdate::DATE, '%Y%m') AS month, o_custkey // 7 * 7 AS step, o_totalprice FROM orders), c AS (SELECT max(month) AS newest, max(step) AS latest, count(DISTINCT month) AS files FROM r)
 SELECT 'result=' || newest AS newest, 'checkpoint=step-' || latest AS latest, files::INTEGER AS files, (SELECT count(*) FROM r WHERE month = newest) AS newest_rows, (SELECT count(*) FROM r WHERE step = latest) AS latest_rows FROM c""")
def newest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as results by month and as checkpoints by customers: the last result by name and the checkpoint with the largest number, how many results there are, and the rows of both, read back.

    A checkpoint holds the steps since the one before it, and there are CHECKPOINTS of them at most, however many customers there are.
    """
    where, orders = _folder(spark, "listing"), table(spark, sf_dir, "orders")
    orders.select(F.date_format("o_orderdate", "yyyyMM").alias("result"), "o_totalprice").repartition("result").write.partitionBy("result").csv(f"{where}/results")
    steps = orders.select((F.floor(F.col("o_custkey") / 7) * 7).alias("step"), "o_totalprice")
    least, most = steps.agg(F.min("step"), F.max("step")).first()
    part = F.floor((F.col("step") - F.lit(least)) / F.lit((((most or 0) - (least or 0)) // CHECKPOINTS) + 1))
    steps = steps.withColumn("part", part)
    last = steps.groupBy("part").agg(F.concat(F.lit("step-"), F.max("step").cast("string")).alias("checkpoint"))
    # CHECKPOINTS rows
    steps.join(F.broadcast(last), "part", "left").select("checkpoint", "step", "o_totalprice").repartition("checkpoint").write.partitionBy("checkpoint").csv(f"{where}/checkpoints")
    newest, latest = readers.newest(spark, f"{where}/results", "result=*"), readers.latest_checkpoint(spark, f"{where}/checkpoints")
    name = lambda path: F.lit(path.rstrip("/").rpartition("/")[2])
    count = lambda n: F.count(F.lit(1)).alias(n)
    own = F.col("step") == latest.rstrip("/").rpartition("-")[2]
    held = readers.csv(spark, latest, ["step", "o_totalprice"], header=False).filter(own)
    both = readers.csv(spark, newest, ["o_totalprice"], header=False).agg(count("newest_rows")).join(held.agg(count("latest_rows")), F.lit(True))
    return both.select(name(newest).alias("newest"), name(latest).alias("latest"), F.lit(len(readers.listed(spark, f"{where}/results", "result=*"))).alias("files"), "newest_rows", "latest_rows")


@query("""WITH w AS (SELECT item_id::VARCHAR AS doc, unnest(string_split(regexp_replace(text, '[^a-z ]', '', 'g'), ' ')) AS t FROM benchmark) SELECT doc, count(*) AS n, sum(length(t))::BIGINT AS chars FROM w GROUP BY doc""")
def hocr_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hOCR pages with a namespace, a file each, read whole: their words, the empty ones too."""
    where = _folder(spark, "hocr")
    words = F.split(F.regexp_replace("text", "[^a-z ]", ""), " ")
    word = lambda w, i: F.format_string("<span class='ocrx_word' title='bbox %d 20 %d 40; x_wconf 90'>%s</span>", 10 * i, 10 * i + 8, w)
    page = F.concat(F.lit("<html xmlns='http://www.w3.org/1999/xhtml'><p class='ocr_par'>\n<span class='ocr_line' id='line_1' title='bbox 0 20 900 40; x_size 30'>\n"), F.array_join(F.transform(words, word), "\n"), F.lit("</span></p></html>"))
    table(spark, sf_dir, "benchmark").select(page.alias("value"), "item_id").write.partitionBy("item_id").text(where)
    pages = readers.whole_texts(spark, f"{where}/*").select(F.regexp_extract(F.col("path"), r"item_id=([^/]+)/", 1).alias("doc"), marks.without_namespace(F.col("text")).alias("hocr"))
    return marks.hocr_words(pages).groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("""WITH w AS (SELECT doc_id, doc_id % 5 AS volume, regexp_replace(text, '[^ -~]', '', 'g') AS line FROM documents WHERE text IS NOT NULL) SELECT volume, (row_number() OVER (PARTITION BY volume ORDER BY doc_id) - 1)::INTEGER AS line_no, doc_id || ' ' || line AS line FROM w""")
def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five texts of many lines, each a folder of files that many tasks write in order, read in pieces and numbered."""
    where, docs = f"{_folder(spark, 'lines')}/volumes", table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    line = F.concat_ws(" ", F.col("doc_id").cast("string"), F.regexp_replace("text", "[^ -~]", "")).alias("value")
    tasks = max(5, int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs.withColumn("volume", F.col("doc_id") % 5).repartitionByRange(tasks, "volume", "doc_id").sortWithinPartitions("volume", "doc_id").select("volume", line).write.partitionBy("volume").text(where)
    read = [readers.numbered_lines(spark, f"{where}/volume={k}", together=True).withColumn("volume", F.lit(k).cast("long")) for k in range(5)]
    return reduce(DataFrame.unionByName, read).select("volume", "line_no", "line")


@query("""SELECT conv_id::VARCHAR AS filename, turn::VARCHAR AS page, text AS gt, translate(text, 'lO', '10') AS ocr FROM conversations WHERE text IS NOT NULL""")
def article_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles as JSON lines with a map from page to its texts."""
    where = _folder(spark, "articles")
    page = F.struct(F.col("text").alias("PDF"), F.translate("text", "lO", "10").alias("OCR"))
    turns = table(spark, sf_dir, "conversations").filter("text IS NOT NULL").select(F.col("conv_id").cast("string").alias("filename"), F.create_map(F.col("turn").cast("string"), page).alias("pages"))
    turns.write.json(where)
    return readers.article_pages(spark, where)


def _logs(spark: SparkSession, sf_dir: str) -> str:
    """Metric logs of several runs, derived from all events: a folder of lines for each run and metric."""
    where = f"{_folder(spark, 'runs')}/logs"
    line = F.concat_ws(" ", (F.col("event_id") + 1_000_000).cast("string"), F.col("value").cast("string"), F.col("event_id").cast("string"))
    rows = table(spark, sf_dir, "events").filter("value IS NOT NULL").select(F.concat(F.lit("r"), (F.col("user_id") % 8).cast("string")).alias("run"), F.col("event_type").alias("metrics"), line.alias("value"))
    rows.repartition("run", "metrics").write.partitionBy("run", "metrics").text(where)
    return where


_BEST = "SELECT 'r' || (user_id % 8) AS run, event_type AS metric, min(value)::DOUBLE AS best, arg_min(event_id, (value, event_id))::BIGINT AS step, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL"


@query(_BEST)
def metric_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best step of every run and metric, from their logs."""
    return growth.best_steps(readers.metric_log(spark, f"{_logs(spark, sf_dir)}/*/*"))


@query(_BEST)
def streamed_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, as the logs' files come a few at a time."""
    where = _logs(spark, sf_dir)
    live.best_steps(readers.metric_stream(spark, f"{where}/*/*", 8), f"{where}-best", f"{where}-state")
    return spark.read.parquet(f"{where}-best")


@query("""SELECT item_id::VARCHAR AS doc, (CASE WHEN item_id % 5 = 4 THEN 1 ELSE length(text) % 50 + 1 END)::INTEGER AS n_pages FROM benchmark WHERE text IS NOT NULL""")
def pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of PDF files by their page trees, a file for each item of the benchmark; one where a tree has no count."""
    where, n = _folder(spark, "pdfs"), (F.length("text") % 50 + 1).cast("string")
    count = F.when(F.col("item_id") % 5 == 4, F.lit("")).otherwise(F.concat(F.lit(" /Count "), n))
    kid = F.when(F.col("item_id") % 2 == 0, F.lit("\n2 0 obj\n<< /Type /Pages /Parent 1 0 R /Kids [] >>\nendobj")).otherwise(F.lit(""))
    body = F.concat(F.lit("%PDF-1.4\n1 0 obj\n<< /Type /Pages /Kids []"), count, F.lit(" >>\nendobj"), kid)
    table(spark, sf_dir, "benchmark").filter("text IS NOT NULL").select(body.alias("value"), "item_id").write.partitionBy("item_id").text(where)
    return readers.page_counts(spark, f"{where}/*").select(F.regexp_extract("path", r"item_id=([^/]+)/", 1).alias("doc"), "n_pages")


@query("""WITH c AS (SELECT *, (ntile(92) OVER (ORDER BY doc_id) - 1)::INTEGER AS chunk FROM documents) SELECT chunk, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last, sum(length(text))::BIGINT AS chars FROM c GROUP BY chunk""")
def chunk_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder for each chunk of consecutive documents, read back."""
    where = _folder(spark, "chunks")
    sinks.write_chunks(table(spark, sf_dir, "documents"), where, "doc_id", 92)
    return spark.read.parquet(where).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.sum(F.length("text")).alias("chars"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'first' ELSE 'second' END AS run FROM documents")
def resumed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that was stopped after a third of the rows goes on with the others."""
    where, docs = _folder(spark, "resumed"), table(spark, sf_dir, "documents").select("doc_id")
    sinks.write_pending(docs.filter("doc_id % 3 = 0").withColumn("run", F.lit("first")), where, "doc_id")
    sinks.write_pending(docs.withColumn("run", F.lit("second")), where, "doc_id")
    return spark.read.parquet(where)


@query("SELECT event_id, user_id, event_type, value FROM events")
def appended_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of several batches into a ledger, taken twice over, the second time with a lost checkpoint: each row is there once."""
    where, schema = _folder(spark, "ledger"), table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value").schema
    table(spark, sf_dir, "events").select(*schema.names).repartition(6).write.parquet(f"{where}/in")
    grown = Ledger(spark, f"{where}/log", schema)
    for run in ("first", "again"):
        append_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{where}/in"), grown, f"{where}/{run}")
    return grown.read()


@query("""WITH a AS (SELECT count(*) AS n, 0.0::DOUBLE AS zero, min(o_totalprice)::DOUBLE AS least FROM orders), m AS (UNPIVOT (SELECT n::DOUBLE AS n, zero, least FROM a) ON n, zero, least INTO NAME metric VALUE value)
 SELECT metric, value, printf('%.2f', value) AS printed, format('{:,}', value::BIGINT) AS whole FROM m""")
def printed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as they are printed: with two decimals, and whole with commas."""
    wide = table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("n"), F.lit(0.0).alias("zero"), F.min("o_totalprice").alias("least"))
    return sinks.metric_rows(wide)


@query("SELECT (row_number() OVER (ORDER BY ((doc_id % 1000003) * 7919 + 3 * 104729) % 1000003, doc_id) - 1) AS place, * FROM documents")
def shuffled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in a random order that every run repeats, with their places."""
    return R.shuffled(table(spark, sf_dir, "documents"), "doc_id", seed=3, column="place")


@query("""WITH s AS (SELECT doc_id FROM documents ORDER BY ((doc_id % 1000003) * 7919 + 104729) % 1000003, doc_id LIMIT 5), n AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM documents)
 SELECT 'key' AS found_by, d.* FROM documents d JOIN s USING (doc_id) UNION ALL SELECT 'number', n.* EXCLUDE (k) FROM n WHERE k IN (0, 150)""")
def looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by key, from a store in buckets, and by number, from one in chunks."""
    where, docs = _folder(spark, "stores"), table(spark, sf_dir, "documents")
    keys = [r["doc_id"] for r in R.sample(docs.select("doc_id"), "doc_id", 5, seed=1).collect()]  # five
    by_key = KeyStore(spark, f"{where}/keys", "doc_id", 16).write(docs).get(keys)
    rows = RowStore(spark, f"{where}/rows", "doc_id", 12).write(docs)
    found = [by_key.withColumn("found_by", F.lit("key")), *(rows.get(n).withColumn("found_by", F.lit("number")) for n in (0, 150))]
    return reduce(DataFrame.unionByName, found)
