"""Best-fit packing of documents into fixed-length sequences by exact-complement hashing.

Method: pieces of equal length are interchangeable, so packing works on the histogram of lengths, which has
``capacity`` entries at most whatever the number of documents. For each length, longest first, the gap it
leaves is looked up in an index of single lengths, pair sums and triple sums; a combination that fills the gap
exactly is consumed as often as the availability counts allow. What is left goes by best fit, longest first, into the
smallest gap that holds it. A few limits on the combinations are tried and the plan of the fewest sequences is taken;
of equal ones the first. The plan is a list of patterns with multiplicities; pieces are dealt to its slots
by their rank within their length, which is found without any task seeing all pieces of a common length.

Defined results: null and empty texts are one piece of the end id alone. Repeated rows are separate documents.
Only documents longer than the capacity are cut; their first piece takes the remainder. Very long texts are encoded
whole. Pieces of equal length are dealt in order of a hash of ``doc_id`` and ``piece``, then of these and the checksum, at
every size. Columns beside ``doc_id`` and
``text`` are not looked at. An empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymark.llm.common import texts, tune, written
from tallymark.llm.tokens import END_ID, encoder

CAPACITY = 1024
#: How many lengths may fill a gap exactly, and the least of them; short lengths that are not used up fill what is left.
TRIES = ((3, 1), (3, 64), (3, 128), (1, 1))
#: A window that ranks pieces of one length sees about this many.
RANK_ROWS = 200_000


def cuts(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, ...]:
    """Row, number, start and length of each piece of rows of so many tokens; the first piece takes the remainder."""
    n = -(-sizes // capacity)
    row = np.repeat(np.arange(len(sizes)), n)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    first = sizes - (n - 1) * capacity
    start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
    return row, piece, start, np.where(piece == 0, first[row], capacity)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenize and cut: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer_path)
        for batch in batches:
            ids, at = e.encode_all(batch.column("text"), end_id)
            row, piece, start, length = cuts(np.diff(at), capacity)
            begin = at[row] + start
            sums = [zlib.crc32(ids[a:b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
            cols = [batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32"])

    tune(docs.sparkSession)
    return texts(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class SumIndex:
    """Availability of lengths, and for each sum the single, pairs and triples of present lengths that make it.

    A pair is kept under its sum by its longer length, a triple by its longest one and the sum of the other two, so
    the index has at most ``capacity`` squared entries.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.have = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.have[length] = n
        present = np.flatnonzero(self.have)[::-1]
        self.pairs: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.triples: list[list[int]] = [[] for _ in range(capacity + 1)]
        for a in present.tolist():
            for b in present[present <= min(a, capacity - a)].tolist():
                self.pairs[a + b].append(a)
        sums = np.flatnonzero([bool(p) for p in self.pairs])
        for a in present.tolist():
            for rest in sums[sums <= min(2 * a, capacity - a)].tolist():
                self.triples[a + rest].append(a)

    def combinations(self, gap: int) -> Iterator[tuple[int, ...]]:
        """What fills ``gap`` exactly by the lengths left, the fewest and longest lengths first."""
        yield (gap,)
        for a in self.pairs[gap]:
            if self.have[a] and self.have[gap - a]:
                yield (a, gap - a)
        for a in self.triples[gap]:
            for b in self.pairs[gap - a] if self.have[a] else ():
                if b <= a and self.have[b] and self.have[gap - a - b]:
                    yield (a, b, gap - a - b)

    def consume(self, lengths: tuple[int, ...]) -> int:
        """Take ``lengths`` as often as their counts allow."""
        need = {x: lengths.count(x) for x in lengths}
        times = min(int(self.have[x]) // k for x, k in need.items())
        for x, k in need.items():
            self.have[x] -= k * times
        return times


def filled(counts: dict[int, int], capacity: int, most: int, least: int) -> list[tuple[int, tuple[int, ...]]]:
    """One plan: gaps filled exactly by at most ``most`` lengths of ``least`` or more, then best fit, longest first."""
    index = SumIndex(counts, capacity)
    have, out = index.have, []
    for length in range(capacity, 0, -1):
        for rest in index.combinations(capacity - length) if length < capacity else ((),):
            if not have[length]:
                break
            if len(rest) <= most and min(rest, default=capacity) >= least and (times := index.consume((length, *rest))):
                out.append((times, (length, *rest)))

    #: Open bins by gap, as [how many, lengths so far], and a bit for each gap that has some.
    bins: dict[int, list[list]] = defaultdict(list)
    some = 0
    for length in range(capacity, 0, -1):
        n = int(have[length])
        while n:
            fits = some >> length
            if not fits:
                each = min(n, capacity // length)
                gap = capacity - each * length
                bins[gap].append([n // each, (length,) * each])
                some |= 1 << gap
                n %= each
                continue
            gap = length + (fits & -fits).bit_length() - 1
            times, lengths = bins[gap][-1]
            k = min(times, n)
            bins[gap - length].append([k, (*lengths, length)])
            some |= 1 << (gap - length)
            if times > k:
                bins[gap][-1][0] -= k
            else:
                bins[gap].pop()
                if not bins[gap]:
                    some &= ~(1 << gap)
            n -= k
    return out + [(times, lengths) for v in bins.values() for times, lengths in v]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns ``(how often, lengths)`` that together use every length as often as ``counts`` says.

    Of the plans made with each of ``TRIES`` the one of the fewest sequences; the first that needs no more than the sum
    of lengths does ends the search.
    """
    bound = -(-sum(k * n for k, n in counts.items()) // capacity)
    best: list[tuple[int, tuple[int, ...]]] = []
    for most, least in TRIES:
        found = filled(counts, capacity, most, least)
        if not best or sum(k for k, _ in found) < sum(k for k, _ in best):
            best = found
        if sum(k for k, _ in best) == bound:
            break
    return best


def ranked(rows: DataFrame, counts: dict[int, int]) -> DataFrame:
    """``rank`` of each row among those of its ``length``, from 0, in order of ``order_of``.

    A length is cut into ranges of that order, as many as it has rows for, so a common length is ranked in many windows
    and the ranks are the same however many there are.
    """
    windows = F.lit(1).cast("long")
    if counts:  # as many entries as lengths, so at most the capacity
        n = F.create_map(*[F.lit(x) for k, v in counts.items() for x in (k, -(-v // RANK_ROWS))])
        windows = F.coalesce(F.element_at(n, F.col("length").cast("int")), F.lit(1)).cast("long")
    order = order_of(F.col("doc_id"), F.col("piece"))
    part = F.shiftright((F.shiftright(order, 32) + (1 << 31)) * windows, 32)
    rows = rows.withColumns({"_order": order, "_part": part})
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy("length", "_part").count().select("length", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("length", "_part").orderBy("_order", "doc_id", "piece", "ids_crc32")
    return rows.join(first, ["length", "_part"]).withColumn("rank", F.col("_first") + F.row_number().over(inside) - 1).drop("_order", "_part", "_first")


def order_of(doc_id, piece) -> F.Column:
    """The order in which pieces of one length are dealt: that of a hash, which cuts into even ranges at any size."""
    return F.xxhash64(doc_id, piece)


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give each piece of ``rows`` its ``sequence_id`` and its ``offset`` there. ``rows`` must be a written table."""
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # at most ``capacity`` rows
    slots: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    taken: dict[int, int] = defaultdict(int)
    sequence = 0
    for times, lengths in plan(counts, capacity):
        offset = 0
        for length in lengths:
            slots[length].append((taken[length], sequence, offset))
            taken[length] += times
            offset += length
        sequence += times
    table = {k: np.array(v, np.int64).T for k, v in slots.items()}

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            ids, at = np.zeros(len(df), np.int64), np.zeros(len(df), np.int64)
            for length, where in df.groupby("length").indices.items():
                first, seq, off = table[length]
                rank = df["rank"].to_numpy()[where]
                k = np.searchsorted(first, rank, "right") - 1
                ids[where], at[where] = seq[k] + rank - first[k], off[k]
            yield df.drop(columns="rank").assign(sequence_id=ids, offset=at)

    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return ranked(rows, counts).select(*cols, "rank").mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def packed(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(written(pieces(docs, tokenizer_path, capacity), "pieces"), capacity)


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
