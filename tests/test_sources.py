import json

from pyspark.sql import functions as F

from quillspark.plans import files
from quillspark.sources import readers, sinks
from quillspark.streaming import live


def test_csv_keeps_text(spark, tmp_path):
    df = spark.createDataFrame([("42", 'a "b"\nc'), (None, "x")], "t string, u string")
    sinks.write_csv(df, str(tmp_path / "c"), sep=";")
    got = readers.csv(spark, str(tmp_path / "c"), ["t", "u"], sep=";")
    assert sorted(tuple(r) for r in got.fillna("-").collect()) == [("-", "x"), ("42", 'a "b"\nc')]


def test_newest_and_checkpoints(spark, tmp_path):
    for name in ("checkpoint-9", "checkpoint-10", "checkpoint-x", "run-1", "run-2"):
        (tmp_path / name).mkdir()
    assert readers.newest(spark, str(tmp_path), "run*").endswith("run-2")
    assert readers.latest_checkpoint(spark, str(tmp_path)).endswith("checkpoint-10")
    assert readers.latest_checkpoint(spark, str(tmp_path / "run-1")) is None


def test_texts_pages_and_logs(spark, tmp_path):
    (tmp_path / "a.tex").write_text("one\ntwo")
    assert sorted(tuple(r) for r in readers.numbered_lines(spark, str(tmp_path / "a.tex")).collect()) == [("a.tex", 0, "one"), ("a.tex", 1, "two")]
    lines = [f"line {k} " + "x" * (k % 50) for k in range(4000)]
    (tmp_path / "big.log").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        read = readers.numbered_lines(spark, str(tmp_path / "*.[lt]*"))
        assert read.rdd.getNumPartitions() > 1
        assert [(r["line_no"], r["line"]) for r in read.filter("doc = 'big.log'").orderBy("line_no").collect()] == list(enumerate(lines))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "p.json").write_text(json.dumps({"filename": "f", "pages": {"1": {"PDF": "g", "OCR": "o"}, "2": {}}}))
    assert [tuple(r) for r in readers.article_pages(spark, str(tmp_path / "p.json")).collect()] == [("f", "1", "g", "o")]
    (tmp_path / "r1" / "metrics").mkdir(parents=True)
    (tmp_path / "r1" / "metrics" / "loss").write_text("5 0.25 10\n6 0.125 20\n")
    log = readers.metric_log(spark, str(tmp_path / "r1" / "metrics" / "loss"))
    assert sorted(tuple(r) for r in log.collect()) == [("r1", "loss", 5, 0.25, 10), ("r1", "loss", 6, 0.125, 20)]
    assert readers.page_count(b"<< /Type /Pages /Kids [] /Count 7 >>") == 7 and readers.page_count(b"broken") == 1


def test_chunks_metrics_and_resuming(spark, tmp_path):
    df = spark.range(7).withColumnRenamed("id", "k")
    sinks.write_chunks(df, str(tmp_path / "chunks"), "k", 3)
    assert {r["chunk"]: r["count"] for r in spark.read.parquet(str(tmp_path / "chunks")).groupBy("chunk").count().collect()} == {0: 3, 1: 2, 2: 2}
    sinks.write_pending(df.filter("k < 4"), str(tmp_path / "out"), "k")
    sinks.write_pending(df, str(tmp_path / "out"), "k")
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(7))
    wide = spark.range(1).select(F.lit(1.005).alias("a"), F.lit(None).cast("double").alias("b"))
    assert {r["metric"]: r["printed"] for r in sinks.metric_rows(wide).collect()} == {"a": "1.01", "b": "NaN"}


def test_stream(spark, tmp_path):
    schema = "ts timestamp, ocr string, gt string"
    spark.sql("SELECT timestamp'2024-01-01 00:01:00' AS ts, 'c0t' AS ocr, 'cot' AS gt UNION ALL SELECT timestamp'2024-01-01 00:12:00', 'ab', 'ab'").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    run = live.windowed_rates(stream, "ts").writeStream.format("memory").queryName("rates").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert sorted((r["edits"], r["chars"]) for r in spark.table("rates").collect()) == [(0, 2), (1, 3)]
    run = live.running_confusion(stream).writeStream.format("memory").queryName("pairs").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert {(r["pdf_letters"], r["ocr_letters"]): r["count"] for r in spark.table("pairs").collect()} == {("c", "c"): 1, ("o", "0"): 1, ("t", "t"): 1, ("a", "a"): 1, ("b", "b"): 1}


def test_lines_of_a_folder_are_numbered_together(spark, tmp_path):
    """Many tasks may write a text in order: one task each wrote and held a whole one before."""
    where = str(tmp_path / "text")
    spark.range(500).repartitionByRange(7, "id").sortWithinPartitions("id").select(F.col("id").cast("string")).write.text(where)
    got = readers.numbered_lines(spark, where, together=True).select("line_no", "line").collect()
    assert len(readers.listed(spark, where, "part-*")) == 7 and sorted((r[0], int(r[1])) for r in got) == [(k, k) for k in range(500)]


def test_checkpoints_do_not_grow_with_customers(spark, tmp_path):
    """20,000 customers had 2,858 folders of checkpoints."""
    orders = spark.range(20_000).select(F.col("id").alias("o_custkey"), F.expr("date '2020-01-01' + cast(id % 90 as int)").alias("o_orderdate"), F.lit(1.5).alias("o_totalprice"))
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    made = []
    folder, files._folder = files._folder, lambda s, name: made.append(str(tmp_path / name)) or made[-1]
    try:
        [row] = files.newest_files(spark, str(tmp_path)).collect()
    finally:
        files._folder = folder
    assert row["latest"] == f"checkpoint=step-{19_999 // 7 * 7}" and row["latest_rows"] == 19_999 % 7 + 1 and row["files"] == 3
    assert len(readers.listed(spark, f"{made[0]}/checkpoints", "checkpoint=*")) <= files.CHECKPOINTS
