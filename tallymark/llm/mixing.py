"""Mixing sources to target weights by hash-threshold histograms.

Method: each document hashes to 60 bits of its id. Sizes are summed by source and hash bucket, and the bucket
in which a source's budget runs out is found from the running sums of its buckets. Only that bucket is
refined, 12 bits at a time, until a bucket is one hash value. A document is in the mix as often as its
source's budget holds the whole source, and once more if its hash is below the source's threshold. Nothing
is sorted by hash and the result depends on ids and sizes alone, so reruns agree.

Targets: sources in order of code points, null last, weigh 1, 2, 3, 1, ...; target is ``min(max_repeat *
source_size, level * weight)`` with the level at which targets add up to all sizes, which is where resharing
the excess of sources at their limit ends.

Defined results: a null text has size 0; sizes of 0 are taken 0 times. Null sources are one source. Rows that
repeat a ``doc_id`` are taken together. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymark.llm.common import n_words, written

BITS, LEVELS = 12, 5
#: Sources up to which the table of sources is sent to every executor; beyond it, a salted join.
BROADCAST_SOURCES = 10_000
SALTS = 64


def hashed(column) -> F.Column:
    """60 bits of the MD5 of an id, as a long."""
    text = F.coalesce(column.cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, max_repeat: int = 3) -> DataFrame:
    """One row for each source: ``source_size``, ``target``, ``repeats`` of the whole source and the ``budget`` left."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double"))
    s = s.withColumn("room", max_repeat * F.col("source_size").cast("double")).withColumn("ratio", F.col("room") / F.col("weight"))
    every = Window.partitionBy()
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    total, weights = F.sum("source_size").over(every).cast("double"), F.sum("weight").over(every)
    s = s.withColumn("try", (total - F.coalesce(F.sum("room").over(before), F.lit(0.0))) / (weights - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    s = s.withColumn("level", F.max(F.when(F.col("try") <= F.col("ratio"), F.col("try"))).over(every))
    s = s.withColumn("target", F.least("room", F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight")))
    s = s.withColumn("repeats", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    return s.select("source", "source_size", "target", "repeats", (F.col("target") - F.col("repeats") * F.col("source_size")).alias("budget"))


def with_source(rows: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """Join rows with the row of their source: sent to all executors if small, else salted, as a source may be hot."""
    s = sources.withColumnRenamed("source", "_source")
    if n_sources <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(s), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("_salt", F.pmod("hash", F.lit(SALTS)))
    s = s.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.join(s, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_salt") == F.col("_s"))).drop("_source", "_salt", "_s")


def thresholds(sizes: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """Adds to each source ``below``: documents of a smaller hash are taken once more, and ``last``: the hash itself too if true."""
    state = sources.select("source", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("at"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        rows = with_source(sizes, state, n_sources).where(F.shiftright("hash", shift + BITS) == F.col("prefix"))
        keys = ["source", "budget", "before"]
        buckets = rows.groupBy(*keys, F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("size"))
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        buckets = buckets.withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(run), F.lit(0)))
        first = buckets.where(F.col("start") + F.col("size") > F.col("budget")).groupBy("source").agg(
            F.min(F.struct(F.col("bucket").alias("prefix"), F.col("start").alias("before"), F.col("size").alias("at"))).alias("b"), F.first("budget").alias("budget"))
        state = written(first.select("source", "budget", "b.prefix", "b.before", "b.at"), "mix")
    found = state.select(F.col("source").alias("_source"), F.col("prefix").alias("below"), (2 * F.col("before") + F.col("at") <= 2 * F.col("budget")).alias("last"))
    return sources.join(found, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")


def mixed(sizes: DataFrame, max_repeat: int = 3) -> DataFrame:
    """``sizes`` has ``source``, ``size`` and ``hash`` and is a written table; adds ``source_size``, ``target`` and ``taken``."""
    sources = written(targets(sizes, max_repeat), "sources")
    n = sources.count()
    out = with_source(sizes, thresholds(sizes, sources, n), n)
    more = F.coalesce((F.col("hash") < F.col("below")) | ((F.col("hash") == F.col("below")) & F.col("last")), F.lit(False))
    return out.withColumn("taken", F.col("size") * (F.col("repeats") + more.cast("long")))


def applied(docs: DataFrame, max_repeat: int = 3) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with its own columns."""
    size, key = n_words(F.col("text")).alias("size"), hashed(F.col("doc_id")).alias("hash")
    sizes = written(docs.select("source", size, key), "sizes")
    sources = written(targets(sizes, max_repeat), "sources")
    n = sources.count()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("source"), key)
    out = with_source(rows, thresholds(sizes, sources, n), n)
    more = F.coalesce((F.col("hash") < F.col("below")) | ((F.col("hash") == F.col("below")) & F.col("last")), F.lit(False))
    return out.withColumn("_n", F.explode(F.array_repeat(F.lit(1), (F.col("repeats") + more.cast("long")).cast("int")))).select("_doc.*")


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), hashed(F.col("doc_id")).alias("hash")), "sizes")
    return mixed(sizes).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS hash
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight
  FROM sizes GROUP BY source),
r AS (SELECT *, 3 * source_size::DOUBLE AS room, 3 * source_size::DOUBLE / weight AS ratio FROM s),
t AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(room) OVER b, 0))
          / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS try
  FROM r WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
u AS (SELECT *, least(room, coalesce(max(CASE WHEN try <= ratio THEN try END) OVER (), 0) * weight) AS target FROM t),
v AS (
  SELECT source, source_size, target,
         CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS repeats
  FROM u),
h AS (SELECT source, hash, sum(size) AS size FROM sizes GROUP BY source, hash),
c AS (
  SELECT source, hash, size,
         coalesce(sum(size) OVER (PARTITION BY source ORDER BY hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM h)
SELECT d.doc_id, d.size, v.source_size, v.target,
       d.size * (v.repeats + CASE WHEN (2 * c.before + c.size)::DOUBLE <= 2 * (v.target - v.repeats * v.source_size) THEN 1 ELSE 0 END) AS taken
FROM sizes d
JOIN v ON d.source IS NOT DISTINCT FROM v.source
JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.hash = c.hash
"""
