import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tallymark.config import Settings
from tallymark.operators import beacons, dedup, ratelimit, store
from tallymark.sources.tables import shared_folder
from tallymark.streaming import ingest, sinks, streams
from tests.test_streams import START, run, source

SETTINGS = Settings(rate_limit=1, ip_salt="pepper")
BEACON = "seq long, recv_ts long, query string, connecting_ip string, n long"


def rows(seed=1, count=160, batches=4):
    r = random.Random(seed)
    out = []
    for i in range(count):
        q = f"advertiser_id=a&campaign_id=camp{r.randrange(3)}&creative_id=c&device_ip=203.0.113.{r.randrange(9)}&country=US"
        out.append((i, START + i * 20 + r.randrange(20), q, f"192.0.2.{r.randrange(3)}", i * batches // count))
    return [*out, (9000, None, "advertiser_id=a", "192.0.2.1", 1), (9001, START + 100, q, "", 0), (9002, START + 101, q, None, 0)]


def campaigns(spark):
    return spark.createDataFrame([("camp0", "active"), ("camp1", "active")], "campaign_id string, value string")


def stream_of(spark, df, path):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path)).drop("n")


def written(spark, path, batches=4):
    df = spark.createDataFrame(rows(), BEACON)
    for i in range(batches):
        df.where(F.col("n") == i).coalesce(1).write.mode("append").parquet(str(path))
    return df


def table(df):
    return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=str)


def expected(spark, settings):
    out = beacons.ingested(spark.createDataFrame(rows(), BEACON).drop("n"), campaigns(spark), settings)
    return {"impressions": beacons.impression_events(out), "ledger": beacons.ledger(out), "raw": beacons.raw_rows(out), "recent": beacons.recent_impressions(out)}, out


def test_a_stream_of_beacons_equals_the_batch_whatever_fails_between(spark, tmp_path, monkeypatch):
    """Runs are ended after the first table of a batch, after all of them, and after the mark; each is taken up again."""
    df = written(spark, tmp_path / "in")
    settings = replace(SETTINGS, dedup_ttl=900)
    folder, real_write, real_commit, real_store = str(tmp_path / "out"), sinks.BatchTables.write, sinks.BatchTables.commit, store.KeyStore.write
    points = []

    def fail_at(point, after=True):
        def wrap(f):
            def g(self, *a, **k):
                name = (point, a[0] if point != "store" else a[1], *sorted(k))
                fails = name in wanted and name not in points
                if fails:
                    points.append(name)
                if fails and not after:
                    raise RuntimeError("lost")
                out = f(self, *a, **k)
                if fails:
                    raise RuntimeError("lost")
                return out

            return g

        return wrap

    def write_one_by_one(self, batch_id, **tables):
        for name, d in tables.items():
            fail_at("write")(real_write)(self, batch_id, **{name: d})

    wanted = {("write", 0, "impressions"), ("write", 1, "ledger"), ("write", 2, "hits"), ("store", 2), ("commit", 1), ("commit", 3)}
    monkeypatch.setattr(sinks.BatchTables, "write", write_one_by_one)
    monkeypatch.setattr(sinks.BatchTables, "commit", fail_at("commit")(real_commit))
    monkeypatch.setattr(store.KeyStore, "write", fail_at("store")(real_store))
    failures = 0
    for _ in range(10):
        one = ingest.Ingest(spark, folder, campaigns(spark), settings, buckets=4)
        query = one.run(stream_of(spark, df, tmp_path / "in"), str(tmp_path / "state"))
        try:
            query.awaitTermination(300)
            break
        except Exception:
            failures += 1
    assert failures == len(points) == len(wanted)
    want, out = expected(spark, settings)
    for name, d in want.items():
        assert table(one.tables.read(name)) == table(d), name
    last = one.tables.committed()
    assert one.store.versions() == [last] and last == 3
    left = lambda name: {f.name for f in (tmp_path / "out" / name).iterdir() if f.name.startswith("batch=")}
    assert left("outcomes") == set() and left("hits") == {"batch=3"} and len(left("raw")) == 4
    end = out.agg(F.max("t")).first()[0]
    assert table(one.store.read(last)) == table(beacons.stored(out, settings, end))
    assert {r.outcome for r in out.select("outcome").distinct().collect()} >= {"counted", "duplicate", "reject_rate_limited", "reject_internal"}


def test_the_store_is_not_moved(spark, tmp_path):
    """A batch meets the store, and the store its next version, on its buckets."""
    keep = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        keys = store.KeyStore(spark, f"{shared_folder(spark)}/moved-{tmp_path.name}", 4)
        seen = keys.write(spark.createDataFrame([(f"k{i}", START + i) for i in range(100)], "key string, exp long"), 0)
        batch = spark.createDataFrame([(f"k{i % 150}", START + i, i) for i in range(300)], "key string, t long, seq long")
        found = dedup.counted_seconds(batch, "key", 50, seen)
        next_one = store.merged(seen, dedup.live_keys(batch, "key", 50, START, seen), START + 60)
        for df, parts in ((found, 1), (next_one, 3)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            scans = [p for p in plan.split("\n") if "FileScan" in p and "Bucketed: true" in p]
            assert len(scans) == parts
            assert all("Exchange" not in line for line in above(plan, "Bucketed: true"))
        assert table(keys.write(next_one, 1)) == table(next_one) and keys.versions() == [0, 1]
        again = store.KeyStore(spark, keys.folder, 4)
        spark.sql(f"DROP TABLE {again.name(1)}")  # as another session finds it
        assert again.read(1).count() == next_one.count()
        again.forget(1)
        assert again.versions() == [1]
    finally:
        for c, v in keep.items():
            spark.conf.set(c, v)


def above(plan, mark):
    """Of each scan with ``mark``, the nodes between it and the first join above."""
    lines, out = plan.split("\n"), []
    for i, line in enumerate(lines):
        if mark in line:
            at = indent(line)
            for up in reversed(lines[:i]):
                if indent(up) < at:
                    at = indent(up)
                    if "Join" in up:
                        break
                    out.append(up)
    return out


def indent(line):
    return len(line) - len(line.lstrip(" :+-"))


def test_hits_of_earlier_batches_count(spark):
    r = random.Random(3)
    data = [(r.choice(["a", "b", "", None]), START + i, i) for i in range(400)]
    df = spark.createDataFrame(data, "k string, t long, seq long")
    want = {x.seq: x.allowed for x in ratelimit.rate_limited(df, "k", 4).collect()}
    before, got = None, {}
    for a in range(0, 400, 70):
        part = df.where(F.col("seq").between(a, a + 69))
        got |= {x.seq: x.allowed for x in ratelimit.rate_limited(part, "k", 4, before=before).collect()}
        n = ratelimit.hits(part, "k", before)
        before = spark.createDataFrame(n.collect(), n.schema)
    assert got == want and not all(want.values())


@pytest.mark.parametrize("limit", [2, 0])
def test_streamed_rate_limit_equals_the_batch(spark, tmp_path, limit):
    streams.use_rocksdb(spark)
    r = random.Random(4)
    df = spark.createDataFrame([(r.choice(["a", "b", "c", "", None]), START + i * 3, i, i // 60) for i in range(240)], "k string, t long, seq long, n long")
    got = run(streams.rate_limited(source(spark, tmp_path, df, 4), "k", limit), tmp_path, "w")
    assert dict(zip(got["seq"], got["allowed"])) == {x.seq: x.allowed for x in ratelimit.rate_limited(df, "k", limit).collect()}


def test_tables_of_any_stream_hold_each_batch_once(spark, tmp_path):
    df = spark.createDataFrame([(i, i // 10) for i in range(30)], "x long, n long")
    path = tmp_path / "in"
    for i in range(3):
        df.where(F.col("n") == i).coalesce(1).write.mode("append").parquet(str(path))
    tables, fails = sinks.BatchTables(spark, str(tmp_path / "t")), [True]

    def make(batch):
        if fails and batch.first().n == 1:
            tables.write(1, even=batch)  # what a broken attempt leaves
            fails.clear()
            raise RuntimeError("lost between two sinks")
        return {"even": batch.where("x % 2 = 0"), "odd": batch.where("x % 2 = 1")}

    for _ in range(2):
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))
        try:
            sinks.to_tables(stream, tables, make, str(tmp_path / "state")).awaitTermination(120)
        except Exception:
            assert sorted(r.x for r in tables.read("even").collect()) == list(range(0, 10, 2))
    assert sorted(r.x for n in ("even", "odd") for r in tables.read(n).collect()) == list(range(30))


def test_a_key_is_walked_whole_beside_a_store_that_turns_out_small(spark):
    """A join with the store that becomes a broadcast while it runs leaves the blocks of a key in one task."""
    new = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    keep = {c: spark.conf.get(c, None) for c in new}
    for c, v in new.items():
        spark.conf.set(c, v)
    try:
        r = random.Random(3)
        events = [(f"k{r.randrange(40)}", START + r.randrange(4000), i) for i in range(3000)]
        held = {f"k{i}": START + 30 * i for i in range(0, 40, 2)}
        batch = spark.createDataFrame(events, "key string, t long, seq long")
        seen = spark.createDataFrame(list(held.items()), "key string, exp long").repartition(4)
        want, end = set(), dict(held)
        for k, t, seq in sorted(events, key=lambda e: (e[1], e[2])):
            if end.get(k, 0) <= t:
                want.add(seq)
                end[k] = t + 50
        for d in (batch, batch.repartition("key").distinct()):
            assert {x.seq for x in dedup.fixed_window(d, "key", 50, seen).where("is_first").collect()} == want
        kept = batch.join(seen.select(F.col("key"), "exp"), "key", "left").where("exp is null or t >= exp").withColumn("after", F.lit(False))
        want = {x.seq for x in dedup.fixed_window(kept, "key", 50).where("is_first").collect()}
        assert {x.seq for x in dedup.rotating(kept, "key", 50).where("is_first").collect()} == want
    finally:
        for c, v in keep.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)
