"""Near duplicates by DartMinHash signatures and banded joining.

Method: darts are thrown at the plane of every element: a region is a slab of weights by a slab of ranks, the
number of darts in it is Poisson distributed with its area as mean, and count, place and coordinate of each
dart come from hashes of the element and the region alone, so two documents share the darts of what they have
in common. A document of total weight ``W`` looks at ranks up to ``DARTS / W``, which holds ``DARTS`` darts on
average however long it is; each of the ``K`` coordinates keeps its earliest dart, and ranks are doubled
until none is empty. Two signatures agree in a coordinate with the weighted Jaccard similarity as probability.

Signatures are cut into ``BANDS`` bands; texts that agree in a band are a bucket. A text is first compared with the
leader (of its buckets) with which it shares most bands. Then the buckets that still hold several classes are
decided whole, each inside a task that has the signatures and the hashed shingles of its members: members outside
the leader's class are held against all, pairs of other classes whose signatures agree in ``SCREEN`` coordinates are
compared exactly, in the first band that they share, and only links that join two classes leave the task, fewer than
the bucket has members. A bucket of more than ``TILE`` bytes is dealt to tasks as blocks of members against members,
after a pass that holds its members against one block only and so joins most of them. Classes are connected
components of the exact links.

Similarity is Jaccard's on distinct shingles of five words, 0.8 or more (``weighted=True``: on counts). Weights are
1 unless ``weighted`` is set, as two texts that repeat a line another number of times are near duplicates here.

Defined results: equal texts are one class, all null and empty texts and those without words another. A text of fewer than five words is one
shingle. A class id is the least ``doc_id`` of the class. A null ``doc_id`` is stood for by a hash of its text, from
2 to the 62nd; so is the ``doc_id`` of further texts (in order of their digests) where rows with other texts
repeat it, so their classes stay apart. Of ties the least id counts. Very long texts are read whole, a batch holds few
of them. Other columns than ``doc_id`` and ``text`` are not looked at. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import lgamma, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.common import WORD, dropped, freed, releasing, texts, tune, written
from tallymark.llm.hashing import U, mix, shingles

WORDS, SIMILAR = 5, 0.8
BANDS, ROWS = 32, 4
K = BANDS * ROWS
DARTS = K * (log(K) + 4)
#: Coordinates that must agree: a pair of similarity 0.8 falls short with a probability under 1e-5.
SCREEN = int(0.64 * K)
FIRST_RANK = 1 / 16
#: Bytes of signatures and shingles up to which a block of a bucket's members is compared in one task.
TILE = 24 << 20
#: Bytes of a member besides its shingles.
MEMBER = 8 * BANDS + 2 * K + 64


@lru_cache(None)
def poisson(mean: float) -> np.ndarray:
    """Probabilities of at most 0, 1, 2, ... darts."""
    n = np.arange(int(mean + 12 * mean**0.5 + 20))
    return np.cumsum(np.exp(n * log(mean) - mean - np.array([lgamma(x + 1) for x in n])))


def slabs(limit: float, first: float) -> list[tuple[float, float]]:
    """Slabs from 0, each as high as all before it, up to ``limit``."""
    out = [(0.0, first)]
    while out[-1][1] < limit:
        out.append((out[-1][1], 2 * out[-1][1]))
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return (x >> U(11)).astype(np.float64) * 2.0**-53


def signature(elements: np.ndarray, weights: np.ndarray, k: int = K, darts: float = DARTS) -> np.ndarray:
    """The earliest dart of each coordinate, as its hash. ``elements`` are distinct hashes, not none."""
    limit = darts / weights.sum()
    while True:
        ranks, coordinates, ids = [], [], []
        for j, (low_w, high_w) in enumerate(slabs(weights.max(), 1.0)):
            inside = weights > low_w if j else slice(None)
            x, w = elements[inside], weights[inside]
            for i, (low, high) in enumerate(slabs(limit, FIRST_RANK)):
                seed = mix(np.array([j * 1000 + i + 1], U))
                n = np.searchsorted(poisson((high_w - low_w) * (high - low)), unit(mix(x ^ seed)), "right")
                some = np.flatnonzero(n)
                n = n[some]
                of = np.repeat(some, n)
                number = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                dart = mix(x[of] + seed * U(3) + number.astype(U) * U(0x9E3779B97F4A7C15))
                rank = low + (high - low) * unit(dart)
                place = mix(dart)
                ok = rank < limit
                if high_w > 1 or weights.min() < 1:
                    ok &= low_w + (high_w - low_w) * unit(mix(place)) < w[of]
                ranks.append(rank[ok])
                ids.append(dart[ok])
                coordinates.append((place[ok] % U(k)).astype(np.int64))
        rank, at, dart = map(np.concatenate, (ranks, coordinates, ids))
        last = np.argsort(-rank, kind="stable")
        out, hit = np.zeros(k, U), np.zeros(k, bool)
        out[at[last]] = dart[last]
        hit[at] = True
        if hit.all():
            return out
        limit *= 2


def elements(text: str, weighted: bool = False) -> tuple[np.ndarray, np.ndarray]:
    x, n = np.unique(shingles(text, WORDS), return_counts=True)
    return x, (n if weighted else np.ones(len(x))).astype(np.float64)


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    s = sig.reshape(-1, rows)
    h = np.arange(1, len(s) + 1).astype(U)
    for i in range(rows):
        h = mix(h * U(0x9E3779B97F4A7C15) + s[:, i])
    return h.view(np.int64)


def signed(docs: DataFrame, weighted: bool = False) -> DataFrame:
    """``key`` and ``same`` of each row and, if it has words and is the first of its text in a task, its bands, its
    signature at 16 bits a coordinate and the number of its elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            keys, sigs, sizes = [], [], []
            for text, same in zip(batch.column("text").to_pylist(), batch.column("same").to_pylist(), strict=True):
                x, w = elements("" if same in seen else text, weighted)
                seen.add(same)
                s = signature(x, w) if len(x) else None
                keys.append(None if s is None else bands(s))
                sigs.append(None if s is None else s.astype(np.uint16).tobytes())
                sizes.append(None if s is None else len(x))
            cols = [batch.column("key"), batch.column("same"), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary()), pa.array(sizes, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, ["key", "same", "bands", "sig", "size"])

    tune(docs.sparkSession)
    return numbered(docs).select("key", "same", "text").mapInArrow(releasing(run), "key long, same string, bands array<long>, sig binary, size int")


def packed(x: np.ndarray, w: np.ndarray, weighted: bool) -> bytes:
    return x.tobytes() + (w.astype(np.float32).tobytes() if weighted else b"")


def unpacked(raw: bytes, weighted: bool) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw) // (12 if weighted else 8)
    return np.frombuffer(raw, U, n), np.frombuffer(raw, np.float32, n, 8 * n) if weighted else np.ones(n, np.float32)


def similarity(a: tuple, b: tuple) -> float:
    """Weighted Jaccard similarity of two texts' ``elements``."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return both / (a[1].sum() + b[1].sum() - both)


def element_sets(docs: DataFrame, nodes: DataFrame, ids: DataFrame, weighted: bool) -> DataFrame:
    """``id`` and ``elements`` (``packed``) of the nodes in ``ids``."""
    need = nodes.join(ids.distinct(), "id", "left_semi").select("id", F.col("key").alias("_key"), F.col("same").alias("_same"))
    rows = numbered(docs).join(need, (F.col("same") == F.col("_same")) & (F.col("key") == F.col("_key"))).select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [packed(*elements(t, weighted), weighted) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.binary())], ["id", "elements"])

    return written(rows.mapInArrow(releasing(run), "id long, elements binary").groupBy("id").agg(F.first("elements").alias("elements")), "elements")


def verified(pairs: DataFrame, sets: DataFrame, similar: float, weighted: bool) -> DataFrame:
    """The pairs ``(a, b)`` whose exact similarity is at least ``similar``."""
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("elements").alias("ea")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("elements").alias("eb")), "b").select("a", "b", "ea", "eb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [
                similarity(unpacked(x, weighted), unpacked(y, weighted)) >= similar
                for x, y in zip(batch.column("ea").to_pylist(), batch.column("eb").to_pylist(), strict=True)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(releasing(run), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``class`` (least id reached) of all that have a link ``(a, b)``.

    Each round a node takes the least label of its neighbours and then the label of its label, so labels travel
    twice as far every round.
    """
    both = written(links.union(links.select("b", "a")).distinct().toDF("id", "other"), "links")
    label = written(both.groupBy("id").agg(F.least(F.min("other"), F.col("id")).alias("class")), "label")
    while True:
        near = both.join(label.select(F.col("id").alias("other"), "class"), "other").groupBy("id").agg(F.min("class").alias("near"))
        step = label.join(near, "id").select("id", F.least("class", "near").alias("to"), F.col("class").alias("was"))
        up = label.select(F.col("id").alias("to"), F.col("class").alias("up"))
        new = written(step.join(up, "to", "left").select("id", F.least("to", F.coalesce("up", "to")).alias("class"), "was"), "label")
        changed = new.where("class <> was").limit(1).count()
        dropped(label)
        label = new.select("id", "class")
        label._table_path = new._table_path
        if not changed:
            dropped(both)
            return label


def screened(pairs: DataFrame, sigs: DataFrame, screen: int) -> DataFrame:
    """Pairs whose 16-bit signatures agree in at least ``screen`` coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(1) >= screen))

    p = pairs.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a")
    p = p.join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b").select("a", "b", "sa", "sb")
    return p.where(F.col("sa").isNotNull() & F.col("sb").isNotNull()).mapInArrow(releasing(run), "a long, b long")


def digest(text: str) -> Column:
    """Digest of a text; those without words have that of the empty text."""
    return F.md5(F.when(F.col(text).rlike(WORD), F.col(text)).otherwise(F.lit("")).cast("binary"))


def stand_in(same: Column) -> Column:
    """A name from 2 to the 62nd for a text whose ``doc_id`` cannot name it."""
    return F.xxhash64(same).bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)


def numbered(docs: DataFrame) -> DataFrame:
    """``key`` (the ``doc_id``, or the text's stand-in where it is null), ``same`` (digest of the text), ``text``."""
    d = texts(docs).withColumn("same", digest("text"))
    return d.select("doc_id", F.coalesce("doc_id", stand_in(F.col("same"))).alias("key"), "same", "text")


def nodes_of(docs: DataFrame, weighted: bool = False) -> DataFrame:
    """A row for each distinct text: its name ``id``, its least ``key``, ``same``, ``bands``, ``sig`` and ``size``."""
    first = [F.first(c, ignorenulls=True).alias(c) for c in ("bands", "sig", "size")]
    nodes = written(signed(docs, weighted).groupBy("same").agg(F.min("key").alias("key"), *first), "nodes")
    again = nodes.groupBy("key").agg(F.count("*").alias("n"), F.min("same").alias("least")).where("n > 1").select("key", "least")
    if not again.limit(1).count():
        return nodes.withColumn("id", F.col("key"))
    other = nodes.join(again, "key", "left").withColumn("id", F.when(F.col("same") > F.col("least"), stand_in(F.col("same"))).otherwise(F.col("key")))
    return written(other.drop("least"), "nodes")


def numbers(x: np.ndarray) -> np.ndarray:
    """The rank of each number among the distinct ones. Holds three times its bytes, and nothing it has done with."""
    order = np.argsort(x)
    ordered = x[order]
    rank = np.zeros(len(x), np.int32)
    np.cumsum(ordered[1:] != ordered[:-1], dtype=np.int32, out=rank[1:])
    del ordered
    codes = np.empty(len(x), np.int32)
    codes[order] = rank
    return codes


class Bucket:
    """Rows of one bucket, or of one block of it, in one task."""

    def __init__(self, rows: pa.Table, weighted: bool):
        self.n = rows.num_rows
        self.key = rows.column("key")[0].as_py()
        self.ids, self.classes, self.query, self.target = (rows.column(c).to_numpy() for c in ("id", "class", "query", "target"))
        self.sigs = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint16).reshape(self.n, -1)
        self.bands = np.array(rows.column("bands").to_pylist(), np.int64)
        sizes = [n for x in rows.column("elements").chunks for n in pc.binary_length(x).to_pylist()]
        self.ends = np.cumsum([0, *sizes]) // (12 if weighted else 8)
        x, self.weights = np.empty(self.ends[-1], U), np.ones(self.ends[-1], np.float32)
        for raw, a, b in zip((r.as_buffer() for c in rows.column("elements").chunks for r in c), self.ends[:-1], self.ends[1:], strict=True):
            x[a:b], self.weights[a:b] = unpacked(raw, weighted)
        self.total = np.add.reduceat(self.weights, self.ends[:-1])
        self.codes = numbers(x)

    def agreeing(self, i: np.ndarray, screen: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each row in ``i`` the targets whose signature agrees, in the first band that both share."""
        targets = np.flatnonzero(self.target)
        step = max(1, (8 << 20) // (self.sigs.shape[1] * max(1, len(targets))))
        for a in range(0, len(i), step):
            some = i[a : a + step]
            x, y = np.nonzero((self.sigs[some][:, None, :] == self.sigs[targets][None, :, :]).sum(2) >= screen)
            x, y = some[x], targets[y]
            keep = np.zeros(len(x), bool)
            for b in range(0, len(x), 50_000):
                one, other = self.bands[x[b : b + 50_000]], self.bands[y[b : b + 50_000]]
                keep[b : b + 50_000] = one[np.arange(len(one)), (one == other).argmax(1)] == self.key
            x, y = x[keep], y[keep]
            for row, start, end in zip(*runs_of(x), strict=True):
                yield row, y[start:end]

    def similar(self, i: int, others: np.ndarray, similar: float, mark: np.ndarray) -> np.ndarray:
        """Which of ``others`` are at least ``similar`` to row ``i``. ``mark``: zeros for every code."""
        own = slice(self.ends[i], self.ends[i + 1])
        mark[self.codes[own]] = self.weights[own]
        sizes = self.ends[others + 1] - self.ends[others]
        at = np.repeat(self.ends[others] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        both = np.add.reduceat(np.minimum(mark[self.codes[at]], self.weights[at]), np.cumsum(sizes) - sizes, dtype=np.float64)
        mark[self.codes[own]] = 0
        return both / (self.total[i] + self.total[others] - both) >= similar

    def links(self, similar: float, screen: int) -> list[tuple[int, int]]:
        """Links that join two classes, each once."""
        out, mark = [], np.zeros(len(self.codes), np.float32)
        label = np.unique(self.classes, return_inverse=True)[1]
        for i, others in self.agreeing(np.flatnonzero(self.query), screen):
            others = others[label[others] != label[i]]
            for j in others[self.similar(i, others, similar, mark)] if len(others) else ():
                if label[j] != label[i]:
                    out.append((min(self.ids[i], self.ids[j]), max(self.ids[i], self.ids[j])))
                    label[label == label[j]] = label[i]
        return out


def runs_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, starts and ends of the runs of equal numbers in ``x``."""
    start = np.flatnonzero(np.diff(x, prepend=-1)) if len(x) else np.zeros(0, np.int64)
    return x[start], start, np.append(start[1:], len(x)) if len(x) else start


def joining(rows: DataFrame, similar: float, screen: int, weighted: bool) -> DataFrame:
    """The links of every block of ``rows``, whose columns are those that ``Bucket`` reads, ``t`` and ``q``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = [pa.Table.from_batches(parts)]
            parts.clear()
            found = Bucket(rows.pop(), weighted).links(similar, screen)
            freed()
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            block = np.stack([batch.column(c).to_numpy() for c in ("key", "t", "q")], 1)
            edges = [0, *np.flatnonzero((block[1:] != block[:-1]).any(1)) + 1, batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if held and tuple(block[a]) != last:
                    yield links(held)
                    held = []
                last = tuple(block[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield links(held)

    names = ["key", "t", "q", "id", "class", "query", "target", "sig", "bands", "elements"]
    block = ["key", "t", "q"]
    return rows.select(*names).repartition(*block).sortWithinPartitions(*block).mapInArrow(releasing(run), "a long, b long")


def blocks(members: DataFrame, tile: int, first: bool) -> DataFrame:
    """Members of the buckets that hold several classes, dealt to blocks ``(key, t, q)`` of about two ``tile`` at most.

    Every member is a target in its tile ``t``; those outside the main class are a query in their part ``q`` against
    each tile. ``first``: against the first tile only.
    """
    size = F.col("size") * 12 + MEMBER
    of = members.groupBy("key").agg(
        F.min("class").alias("low"), F.max("class").alias("high"), F.min_by("class", "id").alias("main"), F.sum(size).alias("bytes")
    ).where("low <> high")
    m = members.join(of.select("key", "main", "bytes"), "key").withColumn("query", F.col("class") != F.col("main"))
    outside = m.where("query").groupBy("key").agg(F.sum(size).alias("outside"))
    m = m.join(outside, "key")
    unit = F.xxhash64("id").bitwiseAND(F.lit((1 << 30) - 1)) / F.lit(float(1 << 30))
    parts = lambda total: F.ceil(F.col(total) / tile).cast("int")
    m = m.withColumn("tiles", parts("bytes")).withColumn("parts", parts("outside"))
    m = m.withColumn("own_t", F.floor(unit * F.col("tiles")).cast("int")).withColumn("own_q", F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")).cast("int"))
    tiles = F.when(F.lit(first), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("tiles") - 1))
    if first:
        m = m.where("tiles > 1")
    targets = m.where("own_t = 0") if first else m
    targets = targets.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("t", F.col("own_t"))
    targets = targets.select("key", "t", "q", "id", "class", (F.col("query") & (F.col("q") == F.col("own_q"))).alias("query"), F.lit(True).alias("target"))
    queries = m.where("query").withColumn("t", F.explode(tiles)).where("t <> own_t")
    return targets.union(queries.select("key", "t", F.col("own_q").alias("q"), "id", "class", F.lit(True).alias("query"), F.lit(False).alias("target")))


def links(docs: DataFrame, nodes: DataFrame, similar: float, weighted: bool, screen: int, tile: int = TILE) -> DataFrame:
    """Classes (``id``, ``class``) of the nodes that have a link."""
    signs = nodes.select("id", "size", "sig", "bands").where("sig is not null")
    member = nodes.select("id", "size", F.explode("bands").alias("key"))
    size = member.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("leader")).where("n > 1").select("key", "leader")
    bucket = written(member.join(size, "key"), "buckets")

    # First each text and the leader with which it shares most bands, so a text is in one pair, however many buckets it is in.
    shared = bucket.where("id <> leader").groupBy("id", "leader").count()
    best = shared.groupBy(F.col("id").alias("a")).agg(F.max_by("leader", F.struct("count", -F.col("leader"))).alias("b"))
    close = written(screened(best, signs, screen), "close")
    sets = element_sets(docs, nodes, close.select(F.col("a").alias("id")).union(close.select("b")), weighted)
    found = written(verified(close, sets, similar, weighted), "verified")
    dropped(close)
    dropped(sets)
    classes = components(found)

    def step(first: bool) -> DataFrame | None:
        """The links found in buckets of several classes; ``first``: in the large ones, against one tile. None: no such bucket."""
        at = bucket.join(classes, "id", "left").select("key", "id", "size", F.coalesce("class", "id").alias("class"))
        rows = written(blocks(at, tile, first), "blocks")
        if not rows.limit(1).count():
            dropped(rows)
            return None
        sets = element_sets(docs, nodes, rows.select("id"), weighted)
        more = written(joining(rows.join(signs, "id").join(sets, "id"), similar, screen, weighted).distinct(), "joining")
        dropped(rows)
        dropped(sets)
        return more

    for first in (True, False):
        more = step(first)
        if more is not None and more.limit(1).count():
            found = written(found.union(more).distinct(), "verified")
            dropped(classes)
            classes = components(found)
    dropped(bucket)
    return classes


def classified(docs: DataFrame, similar: float, weighted: bool, screen: int, tile: int) -> DataFrame:
    """``same``, ``key``, ``id`` and ``class`` of each distinct text."""
    nodes = nodes_of(docs, weighted)
    classes = links(docs, nodes, similar, weighted, screen, tile)
    return nodes.select("same", "key", "id").join(classes, "id", "left").withColumn("class", F.coalesce("class", "id"))


def grouped(docs: DataFrame, similar: float = SIMILAR, weighted: bool = False, screen: int = SCREEN, tile: int = TILE) -> DataFrame:
    """``doc_id``, ``same`` (digest of the text), ``class_id`` and ``is_first`` for each row of ``docs``.

    ``is_first`` marks the rows of a class's least ``doc_id``.
    """
    of = classified(docs, similar, weighted, screen, tile).select("same", F.col("key").alias("_key"), "id", F.col("class").alias("class_id"))
    d = numbered(docs).select("doc_id", "key", "same")
    first = (F.col("id") == F.col("class_id")) & (F.col("key") == F.col("_key"))
    return d.join(of, "same").select("doc_id", "same", "class_id", first.alias("is_first"))


def deduplicated(docs: DataFrame, similar: float = SIMILAR, weighted: bool = False) -> DataFrame:
    """One row of each class, with its own columns: a row of the class's least id."""
    first = classified(docs, similar, weighted, SCREEN, TILE).where(F.col("id") == F.col("class")).select(F.col("key").alias("_key"), F.col("same").alias("_same"))
    rows = docs.withColumn("_same", digest("text"))
    rows = rows.withColumn("_key", F.coalesce(F.col("doc_id"), stand_in(F.col("_same"))))
    return rows.join(first, ["_key", "_same"], "left_semi").dropDuplicates(["_key", "_same"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id")
