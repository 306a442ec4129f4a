from pyspark.sql import functions as F

from tidemark.operators.ingest import thin
from tidemark.streaming.rollup import thin_stream, windowed_counts


def run(stream, name, spark, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name)


def test_thinning_keeps_state_over_batches(spark, tmp_path):
    rows = [(f"s{i % 3}", i * i % 977 * 10 + i, i, i) for i in range(300)]
    df = spark.createDataFrame(rows, "series string, ts_ns bigint, value bigint, event_id bigint").orderBy("ts_ns")
    quiet = 2_000_000
    spread = df.withColumn("ts_ns", F.col("ts_ns") * 100_000)
    cut = spread.approxQuantile("ts_ns", [0.5], 0)[0]
    for i, part in enumerate((spread.filter(F.col("ts_ns") < cut), spread.filter(F.col("ts_ns") >= cut))):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spread.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = run(thin_stream(stream, quiet), "thinned", spark)
    want = thin(spread, quiet)
    assert sorted(r["event_id"] for r in got.collect()) == sorted(r["event_id"] for r in want.collect())


def test_windows(spark, tmp_path):
    spark.sql("SELECT 'a' AS series, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id,0) AS ts, cast(id AS double) AS value FROM range(30)").write.parquet(f"{tmp_path}/w")
    stream = spark.readStream.schema("series string, ts timestamp, value double").parquet(f"{tmp_path}/w")
    got = run(windowed_counts(stream, "ts", "1 minute", "10 minutes"), "windowed", spark, "complete")
    assert sorted((r["cnt"], r["min"], r["max"]) for r in got.collect()) == [(10, 0.0, 9.0), (10, 10.0, 19.0), (10, 20.0, 29.0)]
