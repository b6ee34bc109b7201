"""Compression of vectors to short codes: product codebooks by the filtering form of Lloyd's rounds.

Method: a vector is cut into parts, and each part position has a codebook. Every partition holds its vectors in blocks;
for each part position a block is a kd-tree, whose nodes keep the bounding box, the sum and the count of the points below.
A round walks the trees with the codebook from the root: of the entries that are left for a node, the one nearest the
box's middle is kept, and each other is eliminated that is no nearer (or as near, with a higher index) at the corner of
the box that favours it most, and so at every point of the box. Where one entry is left, the whole subtree is its: the
node's sum and count go to it, and no point is looked at. In leaves the points are compared with the entries left. Tasks
give sums and counts by entry, which are added before they reach the driver: a row for each component of each entry,
whatever the number of vectors. Trees are built once and written; rounds read them.

All arithmetic is exact: components are whole numbers, kept as doubles while every product and sum of them stays below
two to the 53rd, else as Python's integers. Ties go to the lower index.

Defined results: vectors that are null or hold a null or a number that is not finite are dropped. Entries start as the
vectors of the smallest ids, null ids last; of repeated ids the one whose vector sorts first comes first, and every
repeated row is coded. Fewer vectors than entries give fewer entries. Vectors of another length than that of the smallest
id take no part and have a null code and error. A length that the number of parts does not divide is cut at the floors of
its multiples. A null label is a label. Sums and distances that are beyond a long or 38 digits raise an error, they never
wrap. Other columns are not looked at; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.llm.common import dropped, table, tune, written

ENTRIES, PARTS, ROUNDS, SCALE = 256, 4, 4, 1024
#: Vectors of a block, and points of a tree's leaf at most.
BLOCK, LEAF = 4096, 16
#: Labels up to which their sums are sent to every executor.
BROADCAST_LABELS = 100_000


def exact(*arrays: np.ndarray) -> type:
    """``float`` if no distance within these arrays can leave the whole numbers that doubles hold, else ``object``."""
    most = max((float(np.abs(a).max()) for a in arrays if a.size), default=0.0)
    return float if most * most * arrays[0].shape[-1] < 1 << 49 else object


def as_kind(x: np.ndarray, kind: type) -> np.ndarray:
    if kind is float or x.dtype == object:
        return x
    return np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


@dataclass
class Tree:
    """A kd-tree of even halves over ``points``, which stand in the order of the leaves.

    Node ``j`` of level ``l`` has the points from ``n * j >> l`` to ``n * (j + 1) >> l``; nodes are kept level by level.
    """

    points: np.ndarray
    order: np.ndarray
    low: np.ndarray
    high: np.ndarray
    total: np.ndarray

    @staticmethod
    def depth(n: int) -> int:
        return max(0, (-(-n // LEAF) - 1).bit_length())

    @classmethod
    def built(cls, x: np.ndarray) -> Tree:
        """Each node is cut at the median of its widest dimension."""
        n, depth = len(x), cls.depth(len(x))
        order = np.arange(n)
        for level in range(depth if x.shape[1] else 0):
            for j in range(1 << level):
                a, b, mid = n * j >> level, n * (j + 1) >> level, n * (2 * j + 1) >> level + 1
                own = x[order[a:b]]
                wide = int(np.argmax(own.max(0) - own.min(0)))
                order[a:b] = order[a:b][np.argpartition(own[:, wide], mid - a)]
        p = x[order]
        starts = (n * np.arange(1 << depth)) >> depth
        levels = [(np.minimum.reduceat(p, starts), np.maximum.reduceat(p, starts), np.add.reduceat(as_kind(p, exact_sum(p)), starts))]
        for _ in range(depth):
            low, high, total = levels[0]
            levels.insert(0, (np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2]), total[::2] + total[1::2]))
        return cls(p, order, *(np.concatenate([level[i] for level in levels]) for i in range(3)))

    def assigned(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest entry of each point, in the tree's order, and the sums and counts of the points of each entry."""
        n, k, depth = len(self.points), len(entries), self.depth(len(self.points))
        kind = exact(entries, self.low, self.high)
        entries, low, high, points = (as_kind(a, kind) for a in (entries, self.low, self.high, self.points))
        total = as_kind(self.total, object if kind is object else self.total.dtype)
        norm = (entries * entries).sum(1)
        code, sums, counts = np.zeros(n, np.int64), np.zeros((k, entries.shape[1]), total.dtype), np.zeros(k, np.int64)
        nodes, left = np.zeros(1, np.int64), np.ones((1, k), bool)
        for level in range(depth + 1):
            at = nodes + (1 << level) - 1
            lo, hi = low[at], high[at]
            best = np.argmin(np.where(left, norm - (lo + hi) @ entries.T, np.inf), 1)
            f, z = np.nonzero(left)
            s = best[f]
            apart = entries[z] - entries[s]
            corner = np.where(apart > 0, hi[f], lo[f])
            further = norm[z] - norm[s] - 2 * (corner * apart).sum(1)
            gone = (further > 0) | ((further == 0) & (z > s))
            left[f[gone], z[gone]] = False
            alone = left.sum(1) == 1
            one = np.argmax(left, 1)
            for node, i in zip(nodes[alone], one[alone]):
                code[n * node >> level : n * (node + 1) >> level] = i
            np.add.at(sums, one[alone], total[at[alone]])
            np.add.at(counts, one[alone], (n * (nodes[alone] + 1) >> level) - (n * nodes[alone] >> level))
            nodes, left = nodes[~alone], left[~alone]
            if level < depth:
                nodes, left = np.repeat(nodes * 2, 2) + np.tile([0, 1], len(nodes)), np.repeat(left, 2, 0)
        for node, own in zip(nodes, left):
            a, b, some = n * node >> depth, n * (node + 1) >> depth, np.flatnonzero(own)
            code[a:b] = some[np.argmin(norm[some] - 2 * (points[a:b] @ entries[some].T), 1)]
            np.add.at(sums, code[a:b], points[a:b])
            np.add.at(counts, code[a:b], 1)
        return code, sums, counts


def exact_sum(p: np.ndarray) -> type:
    return float if not p.size or float(np.abs(p).max()) * len(p) < 1 << 53 else object


def cuts(size: int, parts: int) -> list[tuple[int, int]]:
    return [(size * i // parts, size * (i + 1) // parts) for i in range(parts)]


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector holds finite numbers alone."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(column).isNotNull() & finite)


def whole(batch: pa.Array, size: int) -> np.ndarray:
    """Vectors of a batch as rows of whole numbers, kept as doubles."""
    return np.floor(batch.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(batch), size) * SCALE)


def packed(x: np.ndarray) -> bytes | None:
    """An array's bytes; sums that are no doubles are not kept, but made again from the points."""
    return None if x.dtype == object else np.ascontiguousarray(x).tobytes()


def forests(vectors: DataFrame, size: int, parts: int) -> DataFrame:
    """Blocks of vectors, a row each: their ids, labels, and a tree for each part."""
    tree = "struct<points: binary, order: binary, low: binary, high: binary, total: binary>"
    schema = T.StructType([T.StructField("ids", T.ArrayType(vectors.schema["vec_id"].dataType)), T.StructField("labels", T.ArrayType(vectors.schema["label"].dataType))])
    schema = T.StructType([*schema.fields, T.StructField("trees", T.DataType.fromDDL(f"array<{tree}>"))])
    kinds = pa.struct([(n, pa.binary()) for n in ("points", "order", "low", "high", "total")])

    def row(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        block = pa.Table.from_batches(held).combine_chunks()
        x = np.concatenate([whole(b.column("embedding"), size) for b in held])
        trees = [Tree.built(np.ascontiguousarray(x[:, a:b])) for a, b in cuts(size, parts)]
        said = [{"points": packed(t.points), "order": packed(t.order), "low": packed(t.low), "high": packed(t.high), "total": packed(t.total)} for t in trees]
        lists = [pa.array([block.column(n).to_pylist()], pa.list_(block.schema.field(n).type)) for n in ("vec_id", "label")]
        return pa.RecordBatch.from_arrays([*lists, pa.array([said], pa.list_(kinds))], ["ids", "labels", "trees"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                held.append(batch.slice(a, BLOCK))
                n += held[-1].num_rows
                if n >= BLOCK:
                    yield row(held)
                    held, n = [], 0
        if n:
            yield row(held)

    tune(vectors.sparkSession)
    return vectors.select("vec_id", "label", "embedding").mapInArrow(run, schema)


def read(trees: list[dict], size: int, parts: int) -> list[Tree]:
    out = []
    for t, (a, b) in zip(trees, cuts(size, parts), strict=True):
        order = np.frombuffer(t["order"], np.int64)
        low, high, points = (np.frombuffer(t[n]).reshape(-1, b - a) if b > a else np.zeros((len(order) if n == "points" else 2 << Tree.depth(len(order)), 0)) for n in ("low", "high", "points"))
        if t["total"] is None:
            x = np.empty_like(points)
            x[order] = points
            out.append(Tree.built(x))
        else:
            out.append(Tree(points, order, low, high, np.frombuffer(t["total"]).reshape(low.shape)))
    return out


def round_of(blocks: DataFrame, books: list[np.ndarray], size: int) -> list[np.ndarray]:
    """The codebooks after one round; entries without points stay."""
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [0] * parts, [0] * parts
        for batch in batches:
            for trees in batch.column("trees").to_pylist():
                for i, tree in enumerate(read(trees, size, parts)):
                    _, s, n = tree.assigned(books[i])
                    sums[i], counts[i] = sums[i] + as_kind(s, object), counts[i] + n
        for i in range(parts):
            used = np.flatnonzero(counts[i]) if not isinstance(counts[i], int) else []
            d = books[i].shape[1]
            rows = [(i, int(e), j, int(counts[i][e]), Decimal(sums[i][e][j])) for e in used for j in range(d)]
            kinds = [("part", pa.int32()), ("entry", pa.int32()), ("place", pa.int32()), ("n", pa.int64()), ("total", pa.decimal128(38, 0))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(list(zip(*rows)) or [[]] * 5, kinds)], [n for n, _ in kinds])

    sums = blocks.select("trees").mapInArrow(run, "part int, entry int, place int, n long, total decimal(38,0)")
    sums = sums.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    new = [as_kind(b, object).copy() for b in books]
    for r in sums.collect():  # a row for each component of each entry
        new[r["part"]][r["entry"]][r["place"]] = int(r["total"]) // r["n"]
    return [b.astype(float) if exact(b.astype(float)) is float else b for b in new]


def coded(blocks: DataFrame, books: list[np.ndarray], size: int) -> DataFrame:
    """``vec_id``, ``label``, ``code`` and ``error`` of each vector."""
    fields = {f.name: f.dataType.elementType for f in blocks.schema.fields if f.name in ("ids", "labels")}
    schema = T.StructType([T.StructField("vec_id", fields["ids"]), T.StructField("label", fields["labels"]), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.slice(i, 1)
                ids, labels = (block.column(n).flatten() for n in ("ids", "labels"))
                codes, error = np.zeros((len(ids), len(books)), np.int64), 0
                for p, tree in enumerate(read(block.column("trees").to_pylist()[0], size, len(books))):
                    near, _, _ = tree.assigned(books[p])
                    kind = exact(books[p], tree.points)
                    off = as_kind(tree.points, kind) - as_kind(books[p], kind)[near]
                    codes[tree.order, p] = near
                    far = np.zeros(len(ids), object)
                    far[tree.order] = [int(v) for v in (off * off).sum(1)]
                    error = error + far
                text = ["".join(f"{c:02x}" for c in row) for row in codes.tolist()]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(text, pa.string()), pa.array(list(error), pa.int64())], ["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(run, schema)


def learned(vectors: DataFrame, entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray], int]:
    """Blocks of usable vectors, the codebooks after all rounds, and the vectors' length. An empty table has no books."""
    order = [F.col("vec_id").asc_nulls_last(), "embedding"]
    first = vectors.orderBy(*order).select(F.size("embedding").alias("n")).limit(1).collect()
    size = first[0]["n"] if first else 0
    vectors = vectors.where(F.size("embedding") == size)
    start = vectors.orderBy(*order).select("embedding").limit(entries).collect()
    x = np.floor(np.array([r["embedding"] for r in start], float).reshape(len(start), size) * SCALE)
    books = [np.ascontiguousarray(x[:, a:b]) for a, b in cuts(size, parts)]
    books = [as_kind(b, exact(b)) for b in books]
    blocks = written(forests(vectors, size, parts), "trees")
    for _ in range(rounds if start else 0):
        books = round_of(blocks, books, size)
    return blocks, books, size


def digest(books: list[np.ndarray]) -> str:
    """Of all entries' components, by part, entry and place."""
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()


def compressed(vectors: DataFrame, entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """``vec_id``, ``label``, ``code``, ``error``, ``label_error`` of each usable vector, and the codebooks.

    ``vectors``: ``vec_id``, ``embedding``, ``label``. A code has two hexadecimal digits for each part.
    """
    if entries > 256:
        raise ValueError("a code has two digits for each part")
    d = usable(vectors.select("vec_id", "embedding", "label"))
    blocks, books, size = learned(d, entries, parts, rounds)
    codes = coded(blocks, books, size)
    other = d.where(F.size("embedding") != size).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    codes = written(codes.union(other), "codes")
    dropped(blocks)
    sums = codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    if sums.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        sums = F.broadcast(sums)
    return codes.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label"), books


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compressed(table(spark, sf_dir, "embeddings"))
    return codes.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds one by one: every part against every entry."""
    near = "arg_min(e, (xx - 2 * list_inner_product(x, c) + cc) * 256 + e)"
    ctes = [
        """kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        """pt AS MATERIALIZED (
  SELECT vec_id, label, p, v[len(v) * p // 4 + 1 : len(v) * (p + 1) // 4] AS x, list_inner_product(x, x) AS xx FROM kept, (SELECT unnest(range(4)) AS p))""",
        """c0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c, xx AS cc FROM pt QUALIFY e < 256)""",
    ]
    for r in range(ROUNDS + 1):
        ctes.append(f"a{r} AS MATERIALIZED (SELECT vec_id, p, any_value(x) AS x, {near} AS e FROM pt JOIN c{r} USING (p) GROUP BY vec_id, p)")
        if r < ROUNDS:
            ctes.append(
                f"""c{r + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(m, c) AS c, list_inner_product(coalesce(m, c), coalesce(m, c)) AS cc FROM c{r} LEFT JOIN (
    SELECT p, e, list(m ORDER BY i) AS m FROM (SELECT p, e, i, floor(sum(x[i]) / count(*)) AS m FROM a{r}, (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM pt))) AS i) WHERE i <= len(x) GROUP BY p, e, i) GROUP BY p, e)
  USING (p, e))"""
            )
    last = f"c{ROUNDS}"
    return f"""WITH {", ".join(ctes)},
done AS (
  SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', a.e), '' ORDER BY p) AS code, sum(xx - 2 * list_inner_product(pt.x, c) + cc)::BIGINT AS error
  FROM a{ROUNDS} a JOIN pt USING (vec_id, p) JOIN {last} k USING (p, e) GROUP BY vec_id),
book AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda v: v::BIGINT), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM {last})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM done, book"""


OP11_SQL = _sql()
