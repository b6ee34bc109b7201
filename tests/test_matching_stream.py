import random

import pandas as pd
from pyspark.sql import functions as F

from tallymark.config import Settings
from tallymark.operators import attribution
from tallymark.streaming import matching, streams

START = 1_704_067_200
CALLS = "call_seq long, store_key string, call_ts long, caller_state string, t long, n long"
RECENT = "store_key string, ts long, seq long, ip string, rida string, hh_id string, region string, city string, postal string, lmt boolean, n long"


def source(spark, path, rows, schema, batches):
    df = spark.createDataFrame(rows, schema)
    for i in range(batches):
        df.where(F.col("n") == i).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path)).drop("n"), df.drop("n")


def run(stream, tmp_path):
    out = []
    q = stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
    q.foreachBatch(lambda b, _: out.append(b.toPandas())).start().awaitTermination(300)
    return pd.concat(out)


COLUMNS = ["candidates", "confidence", "gate", "matched", "device_ids"]


def plain(row):
    return tuple(row[c] for c in COLUMNS), None if row["best"] is None else tuple(row["best"][c] for c in attribution.BEST)


def test_streamed_calls_are_matched_as_the_batch_does(spark, tmp_path):
    """Impressions before, in and after the windows; a store above the ceiling; calls that come hours after their start."""
    streams.use_rocksdb(spark)
    r, batches, step = random.Random(7), 5, 3600
    states = ["Texas", "Ohio", ""]
    imps = [(f"s{r.randrange(4)}", START + i * step // 40 + r.randrange(60), i, f"10.0.0.{i % 9}", "rida", "hh", r.choice(states[:2]), "", "", i % 5 == 0, i // 40) for i in range(40 * batches)]
    imps += [("hot", START + 2 * step + i % 300, 1000 + i, "10.0.0.1", "", "", "Texas", "", "", False, 2) for i in range(120)]
    calls = []
    for i in range(60):
        t = START + step // 2 + r.randrange(step * (batches - 1))
        late = r.choice([0, 0, 30, 7200, -200])  # reported long after the start, or a little before it
        calls.append((i, r.choice(["s0", "s1", "s2", "s3", "none"]), t - late, r.choice(states), t, (t - START) // step))
    calls += [(100 + i, "hot", START + 2 * step + 250 + i, "Texas", START + 2 * step + 400 + i, 2) for i in range(5)]
    end = START + 40 * step
    calls += [(200 + i, "s1", START + step, "Texas", START + step, 1) for i in range(3)] + [(1 << 60, "s2", START + step, None, START + step, 1)]
    imps.append(("s2", START + step - 5, (1 << 60) + 1, None, "r", None, "Ohio", "", "", None, 0))
    calls.append((999, "beat", end, "", end, batches))
    imps.append(("beat2", end, 99_999, "", "", "", "", "", "", False, batches))
    c, all_calls = source(spark, tmp_path / "c", calls, CALLS, batches + 1)
    i, all_imps = source(spark, tmp_path / "i", imps, RECENT, batches + 1)
    settings = Settings(candidate_ceiling=100, max_candidates=6)
    got = run(matching.matched(c, i, settings), tmp_path)
    want = {x["call_seq"]: plain(x) for x in attribution.matched(all_calls, all_imps, settings).collect() if x["call_seq"] != 999}
    assert {x["call_seq"]: plain(x) for x in got.to_dict("records") if x["call_seq"] != 999} == want
    assert {w[0][2] for w in want.values()} == {"no_match", "too_many_candidates", "low_confidence", "ok"}
    assert not got["call_seq"].duplicated().any()
