"""Beacons from a stream to impressions, ledger, raw rows and what call matching sees, each beacon once.

Every micro-batch goes the way of the batch operators: rate limit, verdict, repeats. What one batch hands to the next are
two tables, the hits of the last minutes and the store of live keys, and both are versions named by the batch. All tables
and versions of a batch count from one mark on, so a batch that fails at any point and is run again starts from the versions
before it and leaves nothing twice.

Batches are in order of arrival, as the reference's one clock is; within a batch beacons are in order of ``recv_ts`` and
``seq``. Hits are kept for ``KEEP`` seconds behind a batch's last beacon.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.config import Settings
from tallymark.operators import beacons as b
from tallymark.operators.ratelimit import hits
from tallymark.operators.store import KeyStore, merged
from tallymark.sources.files import delete, listed
from tallymark.streaming.sinks import BatchTables

KEEP = 3_600


class Ingest:
    """The tables ``impressions``, ``ledger``, ``raw`` and ``recent`` in ``folder``, kept up to date by ``batch``."""

    def __init__(self, spark: SparkSession, folder: str, campaigns: DataFrame, settings: Settings = Settings(), buckets: int = 200):
        self.spark, self.campaigns, self.settings = spark, campaigns, settings
        self.tables = BatchTables(spark, folder)
        self.store = KeyStore(spark, f"{folder.rstrip('/')}/store", buckets)

    def batch(self, beacons: DataFrame, batch_id: int) -> None:
        last = self.tables.committed()
        if batch_id <= last:
            return self.forget(last)
        seen = self.store.read(last) if last >= 0 else None
        before = self.tables.batch("hits", last) if last >= 0 else None
        out = b.ingested(beacons, self.campaigns, self.settings, seen, before)
        self.tables.write(batch_id, outcomes=out)
        out = self.tables.batch("outcomes", batch_id)
        self.tables.write(batch_id, impressions=b.impression_events(out), ledger=b.ledger(out), raw=b.raw_rows(out), recent=b.recent_impressions(out))
        end = out.agg(F.max("t")).first()[0] or 0
        self.tables.write(batch_id, hits=hits(out.select("connecting_ip", "t"), "connecting_ip", before).where(F.col("minute") * 60 > end - KEEP))
        new = b.stored(out, self.settings, end)
        self.store.write(new if seen is None else merged(seen, new, end), batch_id)
        self.tables.commit(batch_id)
        self.forget(batch_id)

    def forget(self, batch_id: int) -> None:
        """What only this batch and the one before needed."""
        self.store.forget(batch_id)
        delete(self.spark, f"{self.tables.folder}/outcomes/batch={batch_id}")
        for name in listed(self.spark, f"{self.tables.folder}/hits"):
            if name.startswith("batch=") and int(name.split("=")[1]) < batch_id:
                delete(self.spark, f"{self.tables.folder}/hits/{name}")

    def run(self, stream: DataFrame, checkpoint: str):
        """All that the stream has now."""
        return stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
