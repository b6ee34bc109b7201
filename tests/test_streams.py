import pandas as pd
from pyspark.sql import functions as F

from tallymark.operators.dedup import claims, fixed_window, rotating
from tallymark.streaming import streams


START = 1_704_067_200  # seconds; no row may be earlier than the first watermark, which is 0


def source(spark, tmp_path, df, batches=3):
    path = str(tmp_path / "in")
    for i in range(batches):
        df.where(F.col("n") % batches == i).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(stream, tmp_path, name, mode="append"):
    out = []
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True)
    q.foreachBatch(lambda b, _: out.append(b.toPandas())).start().awaitTermination(180)
    return pd.concat(out)


def test_streamed_deduplication_equals_the_batch(spark, tmp_path):
    streams.use_rocksdb(spark)
    rows = [(f"k{i % 5}", START + i * 7, i, i // 40) for i in range(120)]
    df = spark.createDataFrame(rows, "key string, t long, seq long, n long")
    got = run(streams.deduplicated(source(spark, tmp_path, df), "key", 100), tmp_path, "d")
    want = {r.seq: r.is_first for r in fixed_window(df, "key", 100).collect()}
    assert dict(zip(got["seq"], got["is_first"])) == want


def test_a_pause_of_the_stream_ends_no_window(spark, tmp_path):
    """Rows of one lifetime that come in batches far apart in time of arrival: only event time counts."""
    streams.use_rocksdb(spark)
    df = spark.createDataFrame([("k", START + 10 * i, i, i // 2) for i in range(12)], "key string, t long, seq long, n long")
    got = run(streams.deduplicated(source(spark, tmp_path, df, 6), "key", 50, "0 seconds"), tmp_path, "p")
    assert {int(s) for s, f in zip(got["seq"], got["is_first"]) if f} == {0, 5, 10}


def test_streamed_rotation_and_claims_equal_the_batch(spark, tmp_path):
    streams.use_rocksdb(spark)
    rows = [(f"k{i % 4}", START + i * 9, i, i > 50, i % 3 > 0, i // 40) for i in range(120)]
    df = spark.createDataFrame(rows, "key string, t long, seq long, after boolean, sent boolean, n long")
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir(), b.mkdir()
    got = run(streams.rotating(source(spark, a, df), "key", 100), tmp_path, "r")
    assert dict(zip(got["seq"], got["is_first"])) == {r.seq: r.is_first for r in rotating(df, "key", 100).collect()}
    got = run(streams.claims(source(spark, b, df), "key", 100), tmp_path, "c")
    assert dict(zip(got["seq"], got["is_claimed"])) == {r.seq: r.is_claimed for r in claims(df, "key", 100).collect()}


def test_streamed_hours_and_candidates(spark, tmp_path):
    streams.use_rocksdb(spark)
    rows = [(f"2024-01-0{1 + i // 40} {i % 20:02d}:10:00", "c", 2, i // 40) for i in range(120)]
    df = spark.createDataFrame(rows, "ts string, campaign_id string, _sample_interval long, n long").withColumn("ts", F.col("ts").cast("timestamp"))
    got = run(streams.hourly(source(spark, tmp_path, df), ["campaign_id"]), tmp_path, "h")
    assert set(got["impressions"]) == {4} and 40 <= len(got) <= 60

    calls = spark.createDataFrame([("s", "2024-01-01 10:00:00", 1, 0), ("s", "2024-01-02 10:00:00", 2, 1), ("s", "2024-01-09 10:00:00", 3, 2)], "store_key string, call_at string, call_seq long, n long").withColumn("call_at", F.col("call_at").cast("timestamp"))
    imps = spark.createDataFrame([("s", "2024-01-01 09:00:00", 0), ("s", "2024-01-01 08:59:59", 0), ("s", "2024-01-02 11:00:00", 1), ("s", "2024-01-09 09:30:00", 2)], "store_key string, imp_at string, n long").withColumn("imp_at", F.col("imp_at").cast("timestamp"))
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir(), b.mkdir()
    pairs = run(streams.candidates(source(spark, a, calls).drop("n"), source(spark, b, imps).drop("n")), tmp_path, "j")
    found = pairs.groupby("call_seq")["imp_at"].count().to_dict()
    assert found[1] == 1 and found[3] == 1 and found.get(2, 0) == 0
