from pyspark.sql import functions as F

from quillspark.sources.lookup import KeyStore, RowStore


def test_a_key_opens_one_file(spark, tmp_path):
    df = spark.range(5000).select((F.col("id") % 1000).alias("k"), F.md5(F.col("id").cast("string")).alias("text")).union(spark.createDataFrame([(None, "none")], "k long, text string"))
    store = KeyStore(spark, f"{tmp_path}/keys", "k", 8).write(df)
    got = store.get([17])
    assert got.count() == 5 and set(got.columns) == {"k", "text"}
    scan = got._jdf.queryExecution().executedPlan().toString()
    assert "key_bucket" in scan and "PartitionFilters" in scan
    read = got.select(F.input_file_name().alias("f")).distinct().collect()
    assert len(read) == 1
    metrics = [m for m in spark.read.parquet(f"{tmp_path}/keys").select(F.input_file_name().alias("f")).distinct().collect()]
    assert len(metrics) == 8
    assert sorted(r["k"] for r in store.get([1, 2, 99_999]).collect()) == [1] * 5 + [2] * 5
    assert [r["text"] for r in store.get([None]).collect()] == ["none"] and store.get([]).count() == 0
    wanted = spark.createDataFrame([(3, "a"), (2000, "b")], "k long, tag string")
    assert store.join(wanted).count() == 5 and store.join(wanted, "left").count() == 6


def test_a_number_opens_one_chunk(spark, tmp_path):
    df = spark.range(103).select((F.col("id") * 37 % 103).alias("k"), F.lit("x").alias("text"))
    store = RowStore(spark, f"{tmp_path}/rows", "k", 10).write(df)
    for number in (0, 10, 11, 32, 33, 42, 43, 102):
        assert [r["k"] for r in store.get(number).collect()] == [number]
    assert store.get(103).count() == 0 and store.get(-1).count() == 0
    (chunk, place) = store.chunk_of(43)
    assert (chunk, place) == (4, 0)
