from hotloom.streaming.ingest import follow, normalise_stream, period_counts


def test_loads_that_follow(spark, tmp_path):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    run = lambda: normalise_stream(follow(spark, str(inbox), "id int, t string"), "t", str(tmp_path / "dict"), out, str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([(1, "2019-01-01 10:00:00"), (2, "garbage")], "id int, t string").write.parquet(str(inbox / "a"))
    files = spark.read.parquet(str(inbox / "a")).inputFiles()
    assert files
    spark.read.parquet(str(inbox / "a")).write.mode("append").parquet(str(inbox))
    run()
    spark.createDataFrame([(3, "2019-01-01 10:00:00"), (4, "1546308752")], "id int, t string").write.mode("append").parquet(str(inbox))
    run()
    assert {r.id for r in spark.read.parquet(out).collect()} == {1, 3, 4}
    assert spark.read.parquet(str(tmp_path / "dict")).count() == 3


def test_period_counts_needs_watermark(spark, tmp_path):
    spark.sql("select timestamp'2020-01-01 00:00:00' as at").write.parquet(str(tmp_path / "s"))
    assert period_counts(follow(spark, str(tmp_path / "s"), "at timestamp"), "at").isStreaming
