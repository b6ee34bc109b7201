"""Removal of passages that an earlier document has, by anchors at the places of a difference cover.

Method: a set of residues modulo a period is a difference cover if any two numbers can be moved on by one same step, less
than the period, so that both fall on it. Words are counted from the start of a document, and only at places whose
residue is in the cover is a short window of words hashed. Two equal passages of ``length`` words, wherever they stand,
then share a short window that begins at the same step into both, an aligned anchor: ``length - period + 1`` words long.

Anchors that documents share are extended to what the passages through them can reach: the words from ``period - 1``
before an anchor to ``length`` behind its start. Where an earlier document has the same reach, all passages through the
anchor are repeated. Of equal reaches only the earliest document's goes on: its passages meet those of the other reaches
by hash, and those that a document before has are repeated. The earliest document that has a passage is always among
these, so nothing is lost, and no two documents are compared pair by pair. Equal anchors, reaches and passages are joined
and summed by hash: no task gathers those of one anchor.

Equality of words, reaches and passages is that of 62-bit hashes modulo a prime.

Defined results: documents are in order of ``doc_id``, null the last; rows of one ``doc_id`` are one document, so none of
them is before another. A null text has no words. Fewer words than ``length`` lose nothing. Repeated rows with one id stay,
and with different ids all but the first lose what they share. Very long texts are read whole. Other columns than
``doc_id`` and ``text`` are not looked at. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.common import dropped, released, table, texts, tune, written
from tallymark.llm.hashing import Ranges, U, words

LENGTH = 50
#: Difference covers: residues modulo a period whose differences are all numbers below it, each once.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 31: (0, 1, 3, 8, 12, 18)}
PERIOD = 31
#: A null ``doc_id`` is behind all others.
LAST = (1 << 63) - 1


@dataclass(frozen=True)
class Windows:
    """Passages of ``length`` words, found by anchors at the cover of ``period``."""

    length: int = LENGTH
    period: int = PERIOD

    def anchors(self, n: int) -> np.ndarray:
        """Places in a document of ``n`` words at which a passage of it can have an anchor."""
        if n < self.length:
            return np.zeros(0, np.int64)
        short = self.length - self.period + 1
        blocks = np.arange(0, n, self.period)[:, None] + np.array(COVERS[self.period])
        at = blocks.ravel()
        return at[at <= n - short]

    def first(self, at: np.ndarray) -> np.ndarray:
        """The first passage through an anchor."""
        return np.maximum(at - self.period + 1, 0)

    def last(self, at: np.ndarray, n: int) -> np.ndarray:
        return np.minimum(at, n - self.length)

    def hashes(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchors of a document given by its words' hashes: place, hash of the short window, hash of the reach."""
        at = self.anchors(len(w))
        if not len(at):
            return at, np.zeros(0, U), np.zeros(0, U)
        ranges = Ranges(w)
        short = ranges.of(at, at + (self.length - self.period + 1))
        low = self.first(at)
        reach = ranges.of(low, self.last(at, len(w)) + self.length) + (at - low).astype(U)
        return at, short, reach


def numbered(docs: DataFrame) -> DataFrame:
    """``id`` (null as the last), ``tag`` (hash of the text; the two name a row) and ``text``."""
    d = texts(docs)
    return d.select(F.coalesce("doc_id", F.lit(LAST)).alias("id"), F.xxhash64("text").alias("tag"), "text", "doc_id")


def anchors(docs: DataFrame, windows: Windows) -> DataFrame:
    """The anchors of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [windows.hashes(words(t)) for t in batch.column("text").to_pylist()]
            row = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
            cols = [np.concatenate([np.zeros(0, kind), *(f[i] for f in found)]) for i, kind in enumerate((np.int64, U, U))]
            at, short, reach = pa.array(cols[0].astype(np.int32)), pa.array(cols[1].view(np.int64)), pa.array(cols[2].view(np.int64))
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(row) for c in ("id", "tag")], at, short, reach], ["id", "tag", "at", "short", "reach"])

    tune(docs.sparkSession)
    return numbered(docs).select("id", "tag", "text").mapInArrow(run, "id long, tag long, at int, short long, reach long")


def beside(docs: DataFrame, rows: DataFrame, entry, kind: str) -> DataFrame:
    """Documents with the list of their ``rows``; ``kind`` of join. Both sides grow with the documents, so neither is sent to all."""
    by = rows.groupBy(F.col("id").alias("_i"), F.col("tag").alias("_t")).agg(F.collect_set(entry).alias("rows"))
    return numbered(docs).join(by.hint("merge"), (F.col("id") == F.col("_i")) & (F.col("tag") == F.col("_t")), kind).drop("_i", "_t")


def open_passages(docs: DataFrame, marks: DataFrame, windows: Windows) -> DataFrame:
    """``id``, ``tag``, ``start`` and hash of the passages through anchors that no earlier document has with all their reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, starts, hashes = [], [np.zeros(0, np.int64)], [np.zeros(0, U)]
            for i, (text, found) in enumerate(zip(batch.column("text").to_pylist(), batch.column("rows").to_pylist(), strict=True)):
                w = words(text)
                at = np.array([x["at"] for x in found], np.int64)
                full = np.array([x["full"] for x in found], bool)
                # Ends and starts of stretches of passages, summed up: what is open and not repeated anyhow.
                change = np.zeros((2, len(w) + 1), np.int64)
                for kind in (0, 1):
                    own = at[full == bool(kind)]
                    np.add.at(change[kind], windows.first(own), 1)
                    np.add.at(change[kind], windows.last(own, len(w)) + 1, -1)
                inside = change.cumsum(1) > 0
                start = np.flatnonzero(inside[0] & ~inside[1])
                if len(start):
                    row.append(np.full(len(start), i))
                    starts.append(start)
                    hashes.append(Ranges(w).of(start, start + windows.length))
            at = pa.array(np.concatenate([np.zeros(0, np.int64), *row]))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("tag").take(at), pa.array(np.concatenate(starts).astype(np.int32)), pa.array(np.concatenate(hashes).view(np.int64))], ["id", "tag", "start", "hash"])

    d = beside(docs, marks, F.struct("at", "full"), "inner").where(F.exists("rows", lambda r: ~r["full"]))
    return d.select("id", "tag", "text", "rows").mapInArrow(run, "id long, tag long, start int, hash long")


def repeated(docs: DataFrame, windows: Windows = Windows()) -> DataFrame:
    """What of each document an earlier one has: ``id``, ``tag``, ``place`` and ``full``: the anchor at ``place`` with all
    passages through it, or the one passage that starts there."""
    spark = docs.sparkSession
    # Anchors are made twice: two passes over the texts take less than a table of all anchors.
    shared = anchors(docs, windows).groupBy("short").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    shared = written(shared.select("short"), "shared")
    hits = written(anchors(docs, windows).join(shared.hint("merge"), "short", "left_semi"), "hits")
    dropped(shared)
    released(spark)
    reaches = written(hits.groupBy("short", "reach").agg(F.min("id").alias("least")), "reaches")
    marks = hits.join(reaches.hint("merge"), ["short", "reach"]).select("id", "tag", "at", (F.col("id") > F.col("least")).alias("full"))
    marks = written(marks, "marks")
    dropped(hits)
    dropped(reaches)
    released(spark)
    passages = written(open_passages(docs, marks, windows), "passages")
    released(spark)
    first = passages.groupBy("hash").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    first = written(first.select("hash", "least"), "first")
    single = passages.join(first.hint("merge"), "hash").where("id > least").select("id", "tag", F.col("start").alias("place"), F.lit(False).alias("full"))
    single = written(single, "single")
    for t in (passages, first):
        dropped(t)
    released(spark)
    return marks.where("full").select("id", "tag", F.col("at").alias("place"), "full").union(single)


def cleaned(docs: DataFrame, windows: Windows = Windows()) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` and ``kept`` (the words left, joined by one space)."""
    spans = repeated(docs, windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                w = text.encode("utf-8", "surrogatepass").split()  # bytes are split at ASCII white space alone
                kept = w
                if found:
                    place, full = np.array([x["place"] for x in found], np.int64), np.array([x["full"] for x in found], bool)
                    change = np.zeros(len(w) + 1, np.int64)
                    np.add.at(change, np.where(full, windows.first(place), place), 1)
                    np.add.at(change, np.where(full, windows.last(place, len(w)), place) + windows.length, -1)
                    kept = [w[i] for i in np.flatnonzero(change.cumsum()[:-1] == 0).tolist()]
                left = b" ".join(kept)
                out.append((len(w), len(w) - len(kept), hashlib.sha256(left).hexdigest(), left))
            cols, kinds = list(zip(*out, strict=True)) or [[]] * 4, [pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    d = beside(docs, spans, F.struct("place", "full"), "left").select("doc_id", "text", "rows")
    return d.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary")


def op12_earlier_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(table(spark, sf_dir, "documents")).drop("kept")


OP12_SQL = r"""WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce(doc_id, 9223372036854775807) AS id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS MATERIALIZED (SELECT r, id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT r, id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
first AS (SELECT h, min(id) AS least FROM p GROUP BY h),
hit AS (SELECT r, i FROM p JOIN first USING (h) WHERE id > least),
gone AS (SELECT r, unnest(range(i, i + 50)) AS i FROM hit),
word AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM word ANTI JOIN (SELECT DISTINCT r, i FROM gone) USING (r, i) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT - coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""
