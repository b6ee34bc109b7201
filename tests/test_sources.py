import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallymark.config import export_date
from tallymark.operators.dimensions import dimension
from tallymark.schemas import EVENT_NAMES, EXPORT_KEYS
from tallymark.sources import io


def test_beacons_are_read_by_a_fixed_schema(spark, tmp_path):
    rows = [{"seq": 1, "recv_ts": 5, "query": "a=1", "cf": {"country": "US", "asn": 7, "unknown": "x"}}, {"seq": 2, "recv_ts": 6}]
    (tmp_path / "b.json").write_text("\n".join(map(json.dumps, rows)))
    got = io.read_beacons(spark, str(tmp_path)).orderBy("seq").collect()
    assert (got[0].cf.country, got[0].cf.asn, got[0].connecting_ip) == ("US", 7, None) and got[1].query is None


def test_calls_are_read_with_their_bytes(spark, tmp_path):
    row = (1, 5, "192.0.2.1", "5", "00", bytearray(b'{"callId": "\xff"}'))
    spark.createDataFrame([row], "seq long, recv_ts long, ip string, x_timestamp string, x_signature string, body binary").write.parquet(str(tmp_path / "c"))
    assert bytes(io.read_calls(spark, str(tmp_path / "c")).first().body) == bytes(row[-1])


def test_lookups_of_a_prefix(spark, tmp_path):
    rows = [{"key": "campaign:c1", "value": "active"}, {"key": "number:+1800", "value": "{}"}, {"key": "campaign:c2", "value": "child_directed"}]
    (tmp_path / "kv.json").write_text("\n".join(map(json.dumps, rows)))
    assert sorted(map(tuple, io.read_lookup(spark, str(tmp_path), "campaign:", "campaign_id").collect())) == [("c1", "active"), ("c2", "child_directed")]


def test_area_codes(spark, tmp_path):
    (tmp_path / "a.csv").write_text("area_code,state\n415,California\n007,Nowhere\n")
    assert sorted(map(tuple, io.read_area_codes(spark, str(tmp_path / "a.csv")).collect())) == [("007", "Nowhere"), ("415", "California")]


def test_older_events_lack_names_and_read_as_empty(spark, tmp_path):
    e = spark.createDataFrame([("c1", 2)], "campaign_id string, _sample_interval long").withColumn("ts", F.lit("2024-01-01 05:00:00").cast("timestamp_ntz"))
    io.append_daily(e, str(tmp_path / "e"))
    io.append_daily(e, str(tmp_path / "e"))
    got = io.read_events(spark, str(tmp_path / "e")).collect()
    assert len(got) == 2 and got[0].campaign_id == "c1" and {got[0][n] for n in EVENT_NAMES if n != "campaign_id"} == {""}
    assert (tmp_path / "e" / "dt=2024-01-01").exists()


def test_numbers_that_came_as_text(spark):
    d = spark.createDataFrame([("12", None, "1.5", "x"), ("18446", "7", "bad", "y")], "a string, b string, c string, d string")
    got = io.numeric(d, {"a": "UInt64", "b": "Nullable(UInt64)", "c": "Float64", "d": "String"})
    assert [tuple(r) for r in got.collect()] == [(12, None, 1.5, "x"), (18446, 7, None, "y")]


def test_payloads_and_verdicts_are_written(spark, tmp_path):
    io.write_payloads(spark.createDataFrame([('{"a":1}',)], "payload string"), str(tmp_path / "p"))
    assert [r.value for r in spark.read.text(str(tmp_path / "p")).collect()] == ['{"a":1}']
    for healthy in (False, True):  # the last verdict is the one that is there
        io.write_status(spark.createDataFrame([(healthy,)], "healthy boolean"), str(tmp_path), "health")
    assert [r.healthy for r in spark.read.json(str(tmp_path / "_status" / "health.json")).collect()] == [True]


def test_nightly_exports_and_backfills(spark, tmp_path):
    now = datetime(2026, 9, 15, 2)
    e = spark.createDataFrame([("2026-09-14 05:30:00", 2), ("2026-09-15 01:00:00", 3)], "ts string, _sample_interval long").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    e = e.withColumns({k: F.lit("x") for k in EXPORT_KEYS if k != "hour"})
    assert export_date(now) == "2026-09-14"
    io.nightly_export(spark, e, str(tmp_path), now)
    marker = io.read_marker(spark, str(tmp_path)).first()
    assert (marker.date, marker.rows, marker.partial) == ("2026-09-14", 1, False)
    assert io.backfill(spark, e, str(tmp_path), "2026-09-15", now).first().partial is True
    with pytest.raises(ValueError, match="future"):
        io.backfill(spark, e, str(tmp_path), "2026-09-16", now)


def test_raw_rows_without_an_identifier_are_dealt_to_many_files(spark, tmp_path):
    rows = [("anon", "2026-09-14", "anon", "01", i) for i in range(400)] + [("ab" * 32, "2026-09-14", "abab", "01", i) for i in range(400)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be put together again
    io.write_raw(spark.createDataFrame(rows, "ifa_hash string, dt string, h string, hh string, n long"), str(tmp_path / "r"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = lambda h: len(list((tmp_path / "r" / "dt=2026-09-14" / f"h={h}" / "hh=01").glob("*.parquet")))
    assert files("abab") == 1 < files("anon") and spark.read.parquet(str(tmp_path / "r")).count() == 800


def test_lookup_tables_are_broadcast_only_while_they_are_small(spark):
    many, few = spark.range(1000).withColumnRenamed("id", "k"), spark.range(5)
    plan = lambda rows: many.join(dimension(few, rows), F.col("k") == F.col("id"), "left")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(5) and "broadcast" not in plan(4)
