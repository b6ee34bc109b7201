"""Repeated passages by a logarithmic family of suffix arrays.

Method: a passage of ``length`` bytes contains ``length - SEED + 1`` seeds (runs of ``SEED`` bytes); the one of
the least hash, the first of equals, is its anchor, so equal passages have equal anchors at equal places. Only
suffixes that start at anchors are indexed, about one in ``length / 3`` bytes, and consecutive passages with one anchor
are one entry, a run. The suffix array of a batch of documents holds each run's place, in order of its suffix: by the
suffix's first three bytes, then by the hash of its first ``SEED`` bytes, then by that of the run. Arrays are the levels
of a family, kept in a folder that the next batch finds again: a batch is merge-scanned against each level for suffixes
that both hold, and goes in as a level of its own; levels of equal size merge, so a suffix is merged a number of times
that grows with the logarithm of the batches. A scan gives the places that begin alike, each once in the family's life:
the batch's own, and those of the levels that had nothing alike before.

Long matches are found among these places. Runs of a repeated seed that are equal throughout are repeated throughout.
For the others, a passage is repeated if its hash comes up in two runs of the seed. Those are compared seed by seed on
one example of each distinct run; a seed with more than ``GROUP`` distinct runs is compared passage by passage in a
shuffle instead, with the same result. Equality of runs is that of 64 bits of a cryptographic digest, equality of
passages that of 62-bit hashes modulo a prime; the cheap hashes of seeds choose places and order, and unequal seeds of
equal hash change no result.

The same index over words instead of bytes finds passages of ``PASSAGE`` words that stand in two documents or more,
however many bytes they have; copies within one document do not count there.

Defined results: positions are those of UTF-8 bytes (words: of runs without ASCII white space); null texts are empty
and keep the digest of nothing. Texts shorter than ``length`` lose nothing. Repeated rows repeat each other's bytes; as
to words, rows of one ``doc_id`` are one document. Matches never cross documents. Very long texts are read whole. Of ties
any example serves, the result is the same. Other columns than ``doc_id`` and ``text`` are not looked at. An empty
table gives an empty table.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.common import dropped, new_path, released, texts, tune, written
from tallymark.llm.hashing import Ranges, U, mix, words, words_in

LENGTH, SEED, BATCHES = 400, 96, 4
#: Words of a passage, and of its seeds.
PASSAGE, WORDS = 51, 10
GROUP = 20_000
#: Bytes of short texts whose suffixes are found together; a longer text stands alone.
TOGETHER = 1 << 17
_LOW = 20


def data_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


@dataclass(frozen=True)
class Units:
    """What a text is a sequence of, and how long passages and seeds are. ``across``: only repeats in another document count."""

    length: int = LENGTH
    seed: int = SEED
    words: bool = False
    across: bool = False

    def of(self, text: str) -> np.ndarray:
        return words(text) if self.words else data_of(text)

    def joined(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The units of all texts, one text behind another, and where each text ends."""
        ends = np.cumsum([len(t) + self.words for t in texts])
        data = np.frombuffer((b" " if self.words else b"").join(texts), np.uint8)
        if not self.words:
            return data, ends
        data, at = words_in(data)
        return data, np.searchsorted(at, ends)

    @property
    def kind(self):
        return U if self.words else np.uint8

    def starts(self, data: np.ndarray, at: np.ndarray, seed: np.ndarray) -> np.ndarray:
        """How suffixes at places start, as numbers in their order: the first three bytes (or 24 bits of the first word's
        hash), then 40 bits of the seed's hash."""
        head = data[at] >> U(40) if self.words else (data[at].astype(U) << U(16)) | (data[at + 1].astype(U) << U(8)) | data[at + 2]
        return (((head << U(40)) | (seed >> U(24))) ^ U(1 << 63)).view(np.int64)


BYTES, IN_WORDS = Units(), Units(PASSAGE, WORDS, True, True)


#: An odd base of the cheap hash, and its inverse; arithmetic is modulo 2 to the 64th.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, U), np.ones(1, U)]


def seeds_of(data: np.ndarray, width: int) -> np.ndarray:
    """A cheap hash of each ``width`` consecutive units. It chooses anchors and says nothing about equality."""
    n = len(data)
    if len(_powers[0]) <= n:
        size = 1 << int(n + 1).bit_length()
        for i, base in enumerate((_BASE, _INVERSE)):
            _powers[i] = np.concatenate([[U(1)], np.cumprod(np.full(size - 1, U(base)))])
    sums = np.zeros(n + 1, U)
    np.cumsum((data.astype(U) + U(1)) * _powers[0][:n], out=sums[1:])
    return mix((sums[width:] - sums[: n + 1 - width]) * _powers[1][: n + 1 - width])


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A digest of each range of ``data``, of which 64 bits are kept."""
    raw, step = memoryview(np.ascontiguousarray(data).view(np.uint8)), data.dtype.itemsize
    found = b"".join(hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in zip((start * step).tolist(), (end * step).tolist()))
    return np.frombuffer(found, U)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive numbers."""
    n = len(x) - width + 1
    blocks = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def runs(data: np.ndarray, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """Runs of passages with one anchor: hash of the seed, hash of the run, first passage, passages, anchor."""
    return runs_in(data, np.array([len(data)]), length, seed)


def runs_in(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """``runs`` of texts that stand one behind another in ``data`` and end at ``ends``; places are those in ``data``."""
    sizes = np.diff(ends, prepend=0)
    inside = np.maximum(sizes - (length - 1), 0)  # passages of each text
    n, width = int(inside.sum()), length - seed + 1
    if n < 1:
        return (np.zeros(0, U), np.zeros(0, U), *[np.zeros(0, np.int64)] * 3)
    hashes = seeds_of(data, seed)
    anchors = np.empty(len(data) - length + 1, np.int64)
    step = (1 << _LOW) - width
    for a in range(0, len(anchors), step):
        part = hashes[a : min(a + step, len(anchors)) + width - 1]
        packed = (part >> U(_LOW) << U(_LOW)) | np.arange(len(part), dtype=U)
        low = sliding_min(packed, width)
        anchors[a : a + len(low)] = (low & U((1 << _LOW) - 1)).view(np.int64) + a
    passage = np.arange(n)
    if len(ends) > 1:
        passage += np.repeat(ends - sizes - np.cumsum(inside) + inside, inside)
        anchors = anchors[passage]
    new = np.flatnonzero(anchors[1:] != anchors[:-1]) + 1  # an anchor stands in its passage's text
    new = np.concatenate([[0], new])
    count = np.append(new[1:], n) - new
    first, anchor = passage[new], anchors[new]
    whole = mix(digests(data, first, first + count - 1 + length) + (anchor - first).astype(U) * U(0x9E3779B97F4A7C15))
    return hashes[anchor], whole, first, count, anchor


def together(texts: list[bytes], size: int = TOGETHER) -> Iterator[tuple[int, int]]:
    """Bounds of stretches of texts that hold ``size`` bytes at most, or one text."""
    a, total = 0, 0
    for i, t in enumerate(texts):
        if i > a and total + len(t) > size:
            yield a, i
            a, total = i, 0
        total += len(t)
    if a < len(texts):
        yield a, len(texts)


COLUMNS = {"doc_id": "long", "tag": "long", "seed": "long", "whole": "long", "first": "int", "count": "int", "anchor": "int"}


def suffixes(docs: DataFrame, units: Units = BYTES) -> DataFrame:
    """The anchor suffixes of each document. ``doc_id`` and ``tag`` (hash of the text) name a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, texts = [], batch.column("text").cast(pa.binary()).to_pylist()
            for a, b in together(texts):
                data, ends = units.joined(texts[a:b])
                seed, whole, first, count, anchor = runs_in(data, ends, units.length, units.seed)
                if len(anchor):
                    of = np.searchsorted(ends, first, "right")
                    start = ends[of - 1] * (of > 0)
                    found.append((units.starts(data, anchor, seed), whole.view(np.int64), first - start, count, anchor - start, of + a))
            *values, row = (np.concatenate([np.zeros(0, np.int64), *(f[i] for f in found)]) for i in range(6))
            cols = [batch.column(c).take(pa.array(row)) for c in ("doc_id", "tag")]
            cols += [pa.array(x, kind) for x, kind in zip(values, [pa.int64()] * 2 + [pa.int32()] * 3, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, list(COLUMNS))

    tune(docs.sparkSession)
    d = texts(docs).select("doc_id", F.xxhash64("text").alias("tag"), "text")
    return d.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in COLUMNS.items()))


class Family:
    """Levels of suffix arrays whose sizes double, in a folder that all executors share.

    What the levels are is written last, as a numbered state, so a batch that fails half way leaves the state before.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def states(self) -> list[int]:
        if not self.files.exists(self.path(self.folder)):
            return []
        names = [f.getPath().getName() for f in self.files.listStatus(self.path(self.folder))]
        return sorted(int(n[6:]) for n in names if n.startswith("state-") and self.files.exists(self.path(f"{self.folder}/{n}/_SUCCESS")))

    def levels(self) -> list[tuple[int, str]]:
        """Size and name of each level."""
        states = self.states()
        return [(r["size"], r["name"]) for r in self.spark.read.parquet(f"{self.folder}/state-{states[-1]}").collect()] if states else []  # a row a level

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(", ".join(f"{n} {k}" for n, k in COLUMNS.items())).parquet(f"{self.folder}/{name}")

    def write(self, rows: DataFrame) -> str:
        """A suffix array, in order. All columns are part of the order, so a start that very many have is split."""
        name = f"level-{uuid.uuid4().hex}"
        order = ["seed", "whole", "doc_id", "tag", "first"]
        rows.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(f"{self.folder}/{name}")
        return name

    def commit(self, levels: list[tuple[int, str]], gone: list[str]) -> None:
        """Make ``levels`` the state, and delete what is ``gone``."""
        states = self.states()
        self.spark.createDataFrame(levels, "size int, name string").coalesce(1).write.parquet(f"{self.folder}/state-{states[-1] + 1 if states else 0}")
        for old in [*gone, *(f"state-{n}" for n in states)]:
            self.files.delete(self.path(f"{self.folder}/{old}"), True)

    def merge(self) -> None:
        """Two levels of a size are one of the next."""
        levels = sorted(self.levels())
        for (a, x), (b, y) in zip(levels, levels[1:]):
            if a == b:
                rest = [v for v in levels if v[1] not in (x, y)]
                self.commit([*rest, (a + 1, self.write(self.read(x).union(self.read(y))))], [x, y])
                return self.merge()

    def add(self, batch: DataFrame) -> DataFrame:
        """Index a batch's ``suffixes``; the places that begin like another, each the first time that there is one."""
        self.merge()
        levels = self.levels()
        name = self.write(batch.select(*COLUMNS))
        new = self.read(name)
        starts = written(new.groupBy("seed").agg(F.count("*").alias("n")), "starts")
        # The merge scans: what each level holds of the batch's starts.
        held = [written(self.read(old).join(starts.select("seed"), "seed", "left_semi"), "held") for _, old in levels]
        again, found, before = starts.where("n > 1").select("seed"), new.limit(0), None
        for h in held:
            before = h.select("seed") if before is None else before.union(h.select("seed"))
        if before is not None:
            before = written(before.groupBy("seed").agg(F.count("*").alias("n")), "before")
            again = again.union(before.select("seed")).distinct()
            for h in held:
                found = found.union(h.join(before.where("n = 1").select("seed"), "seed", "left_semi").select(*COLUMNS))
        again = written(again, "again")
        out = written(found.union(new.join(again, "seed", "left_semi").select(*COLUMNS)), "hits")
        self.commit([*levels, (0, name)], [])
        for t in (starts, again, *held, *([] if before is None else [before])):
            dropped(t)
        return out

    def delete(self) -> None:
        self.files.delete(self.path(self.folder), True)


#: Units whose passages are hashed together.
STRETCH = 1 << 20


def passages(rows: dict, units: Units) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each passage of runs given as ``data`` from their first passage on, and its run's number."""
    count, ahead = np.asarray(rows["count"], np.int64), np.asarray(rows["anchor"], np.int64) - np.asarray(rows["first"], np.int64)
    size = count + units.length - 1
    start, found, a = np.cumsum(size) - size, [np.zeros(0, U)], 0
    while a < len(count):
        b = max(a + 1, int(np.searchsorted(start, start[a] + STRETCH)))
        ranges = Ranges(np.frombuffer(b"".join(rows["data"][a:b]), units.kind))
        own = count[a:b]
        inside = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        at = np.repeat(start[a:b] - start[a], own) + inside
        found.append(mix(ranges.of(at, at + units.length) + (np.repeat(ahead[a:b], own) - inside).astype(U)))
        a = b
    return np.concatenate(found), np.repeat(np.arange(len(count)), count)


def spans_of(hit: np.ndarray, of: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Stretches of hit passages as (number of the run, first byte, end)."""
    number = np.arange(len(of)) - np.searchsorted(of, of)
    at = np.flatnonzero(hit)
    if not len(at):
        return at, at, at
    new = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(of[at], prepend=-1) != 0))
    last = np.append(new[1:], len(at)) - 1
    run = of[at[new]]
    return run, first[run] + number[at[new]], first[run] + number[at[last]] + length


EXAMPLE = {"seed": pa.int64(), "low": pa.int64(), "high": pa.int64(), "first": pa.int32(), "count": pa.int32(), "anchor": pa.int32()}


def in_context(docs: DataFrame, examples: DataFrame, units: Units) -> DataFrame:
    """``examples`` with the units of each run as ``data``."""
    by = examples.groupBy(F.col("doc_id").alias("_d"), F.col("tag").alias("_t")).agg(F.collect_list(F.struct(*EXAMPLE)).alias("runs"))
    d = texts(docs).select("doc_id", F.xxhash64("text").alias("tag"), "text")
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("tag") == F.col("_t"))
    d = d.join(by.hint("merge"), same).select("doc_id", "tag", "text", "runs")  # grows with the documents, so it is never sent to all

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("runs").flatten()
            many = np.asarray(batch.column("runs").value_lengths(), np.int64)
            start = np.asarray(found.field("first"), np.int64)
            end = start + np.asarray(found.field("count"), np.int64) + units.length - 1
            parts, r = [], 0
            for text, n in zip(batch.column("text").to_pylist(), many.tolist(), strict=True):
                data = units.of(text)
                raw, step = data.tobytes(), data.dtype.itemsize
                parts += [raw[a:b] for a, b in zip((start[r : r + n] * step).tolist(), (end[r : r + n] * step).tolist())]
                r += n
            at = pa.array(np.repeat(np.arange(len(many)), many))
            cols = [batch.column("doc_id").take(at), batch.column("tag").take(at), *[found.field(n).cast(k) for n, k in EXAMPLE.items()], pa.array(parts, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "tag", *EXAMPLE, "data"])

    return d.mapInArrow(run, "doc_id long, tag long, seed long, low long, high long, first int, count int, anchor int, data binary")


def compared(context: DataFrame, units: Units) -> DataFrame:
    """Repeated stretches of the runs that stand alone; each seed's runs meet in one task, sorted by seed."""
    names = ["doc_id", "tag", *EXAMPLE, "data"]

    def check(rows: dict) -> pa.RecordBatch:
        hashes, of = passages(rows, units)
        back = np.unique(hashes, return_inverse=True)[1]
        low, high = (np.asarray(rows[n], np.int64) for n in ("low", "high"))
        least, most = np.full(len(hashes), np.iinfo(np.int64).max), np.full(len(hashes), np.iinfo(np.int64).min)
        np.minimum.at(least, back, low[of])
        np.maximum.at(most, back, high[of])
        hit = (least < most)[back] & (low == high)[of]
        run, start, end = spans_of(hit, of, np.asarray(rows["first"], np.int64), units.length)
        docs, tags = pa.array(rows["doc_id"], pa.int64()), pa.array(rows["tag"], pa.int64())
        return pa.RecordBatch.from_arrays([docs.take(pa.array(run)), tags.take(pa.array(run)), pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["doc_id", "tag", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {n: [] for n in names}
        for batch in batches:
            for n in names:
                held[n] += batch.column(n).to_pylist()
            seeds = held["seed"]
            cut = len(seeds)  # the last seed may go on in the next batch
            while cut and seeds[cut - 1] == seeds[-1]:
                cut -= 1
            if cut:
                yield check({n: v[:cut] for n, v in held.items()})
                held = {n: v[cut:] for n, v in held.items()}
        if held["seed"]:
            yield check(held)

    rows = context.select(*names).repartition("seed").sortWithinPartitions("seed")
    return rows.mapInArrow(run, "doc_id long, tag long, start long, end long")


def shuffled(context: DataFrame, units: Units) -> DataFrame:
    """The same for seeds of very many distinct runs: passages meet by hash, aggregated before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                hashes, of = passages({n: part.column(n).to_pylist() for n in ("count", "first", "anchor", "data")}, units)
                at = pa.array(of)
                number = np.arange(len(of)) - np.searchsorted(of, of)
                start = np.asarray(part.column("first").to_pylist(), np.int64)[of] + number
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), *[part.column(n).take(at) for n in ("doc_id", "tag", "low", "high")], pa.array(start)], ["hash", "doc_id", "tag", "low", "high", "start"])

    p = context.mapInArrow(run, "hash long, doc_id long, tag long, low long, high long, start long")
    again = p.groupBy("hash").agg(F.min("low").alias("least"), F.max("high").alias("most")).where("least < most").select("hash")
    return p.where("low = high").join(again, "hash").select("doc_id", "tag", "start", (F.col("start") + units.length).alias("end"))


def long_matches(docs: DataFrame, hits: DataFrame, units: Units = BYTES, group: int = GROUP) -> DataFrame:
    """Stretches ``(doc_id, tag, start, end)`` in repeated passages, which may overlap. ``hits``: all places that begin like another."""
    # Who has a run: every run for itself, or its document.
    owner = F.coalesce(F.xxhash64("doc_id"), F.col("tag")) if units.across else F.col("whole")
    example = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "tag", "first", "count", "anchor")).alias("r")
    kinds = hits.groupBy("seed", "whole").agg(F.count("*").alias("n"), F.min(owner).alias("low"), F.max(owner).alias("high"), example)
    everywhere = F.col("low") < F.col("high") if units.across else F.col("n") > 1
    kinds = kinds.select("seed", "whole", "n", everywhere.alias("everywhere"), "low", "high", "r.doc_id", "r.tag", "r.first", "r.count", "r.anchor")
    kinds = written(kinds, "kinds")
    whole = hits.join(kinds.where("everywhere").select("seed", "whole"), ["seed", "whole"])
    whole = whole.select("doc_id", "tag", F.col("first").cast("long").alias("start"), (F.col("first") + F.col("count") + (units.length - 1)).cast("long").alias("end"))
    many = kinds.groupBy("seed").agg(F.count("*").alias("k"), F.bool_and("everywhere").alias("all")).where("k > 1 and not all")
    least, most = F.lit(-(1 << 63)).cast("long"), F.lit((1 << 63) - 1).cast("long")
    low, high = F.when(F.col("everywhere"), least).otherwise(F.col("low")), F.when(F.col("everywhere"), most).otherwise(F.col("low"))
    parts = kinds.join(many.select("seed", "k"), "seed").select("doc_id", "tag", "seed", low.alias("low"), high.alias("high"), "first", "count", "anchor", "k", "everywhere", "whole")
    parts = written(parts, "parts")
    # A run that one document has several times is one kind; every place of it gets what its example gets.
    small = parts.where(F.col("k") <= group)
    alike = compared(in_context(docs, small, units), units)
    if parts.where(F.col("k") > group).limit(1).count():
        large = written(in_context(docs, parts.where(F.col("k") > group), units), "large")
        alike = alike.union(shuffled(large, units))
    if units.across:
        alike = spread(alike, hits, kinds, units)
    return whole.union(alike)


def spread(alike: DataFrame, hits: DataFrame, kinds: DataFrame, units: Units) -> DataFrame:
    """``alike`` and the same stretches at the other places of runs that one document has several times."""
    alike = written(alike, "alike")
    more = hits.join(kinds.where("not everywhere and n > 1").select("seed", "whole", F.col("doc_id").alias("_d"), F.col("tag").alias("_t"), F.col("first").alias("_f"), F.col("count").alias("_n")), ["seed", "whole"])
    more = more.where((F.col("first") != F.col("_f")) | (F.col("tag") != F.col("_t")) | ~F.col("doc_id").eqNullSafe(F.col("_d")))
    a = alike.select(F.col("doc_id").alias("_d2"), F.col("tag").alias("_t2"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    same = F.col("_d").eqNullSafe(F.col("_d2")) & (F.col("_t") == F.col("_t2")) & (F.col("_s") >= F.col("_f")) & (F.col("_e") <= F.col("_f") + F.col("_n") + (units.length - 1))
    moved = more.join(a, same).select("doc_id", "tag", (F.col("_s") + F.col("first") - F.col("_f")).alias("start"), (F.col("_e") + F.col("first") - F.col("_f")).alias("end"))
    return alike.union(moved)


def repeated(docs: DataFrame, units: Units = BYTES, batches: int = BATCHES, group: int = GROUP) -> DataFrame:
    """Repeated stretches of ``docs``, indexed in so many batches; one batch is scanned by itself and not kept."""
    spark = docs.sparkSession
    if batches == 1:
        found = written(suffixes(docs, units), "suffixes")
        who = F.coalesce(F.xxhash64("doc_id"), F.col("tag"))
        starts = found.groupBy("seed").agg(F.count("*").alias("n"), F.min(who).alias("low"), F.max(who).alias("high"))
        again = written(starts.where("low < high" if units.across else "n > 1").select("seed"), "again")
        hits = written(found.join(again, "seed", "left_semi").select(*COLUMNS), "hits")
        dropped(again)
    else:
        batch = F.pmod(F.xxhash64("doc_id", "tag"), F.lit(batches)).cast("int")
        found = written(suffixes(docs, units).withColumn("batch", batch), "suffixes")
        family, hits = Family(spark, new_path(spark, "family")), None
        for i in range(batches):
            new = family.add(found.where(F.col("batch") == i))
            hits = new if hits is None else hits.union(new)
            released(spark)
        family.delete()
    dropped(found)
    released(spark)
    return long_matches(docs, hits, units, group)


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    return union([(s["start"], s["end"]) for s in spans])


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def cleaned(docs: DataFrame, units: Units = BYTES, batches: int = BATCHES, group: int = GROUP, passages: Units = IN_WORDS) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, ``n_passage_words`` (words in passages that
    other documents have too) and ``kept`` (the bytes left)."""
    spans = written(repeated(docs, units, batches, group).select("*", F.lit(False).alias("words")), "spans")
    released(docs.sparkSession)
    spans = spans.union(written(repeated(docs, passages, 1, group).select("*", F.lit(True).alias("words")), "spans"))
    by = spans.groupBy(F.col("doc_id").alias("_d"), F.col("tag").alias("_t")).agg(F.collect_set(F.struct("words", "start", "end")).alias("spans"))
    d = texts(docs).select("doc_id", F.xxhash64("text").alias("tag"), "text")
    d = d.join(by.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("tag") == F.col("_t")), "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, r = [], 0
            found = batch.column("spans").flatten()
            in_words, spans = found.field("words").to_pylist(), list(zip(found.field("start").to_pylist(), found.field("end").to_pylist()))
            for raw, n in zip(batch.column("text").cast(pa.binary()).to_pylist(), pc.fill_null(batch.column("spans").value_lengths(), 0).to_pylist(), strict=True):
                own = list(zip(in_words[r : r + n], spans[r : r + n]))
                r += n
                cut = union([x for w, x in own if not w])
                in_passages = sum(b - a for a, b in union([x for w, x in own if w]))
                parts, at = [], 0
                for a, b in cut:
                    parts.append(raw[at:a])
                    at = b
                kept = b"".join([*parts, raw[at:]]) if cut else raw
                rows.append((len(raw), len(raw) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), in_passages, kept))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words", "kept"])

    return d.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long, kept binary")


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
