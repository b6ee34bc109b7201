"""Shared pieces of the corpus operators: the shared folder, written tables, document input."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule: everything else is a word character.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Arrow batches given to Python hold about this many bytes at most, whatever the text lengths.
ARROW_BYTES = 16 << 20


class Seen:
    """Values of strings that a worker has met: Arrow arrays, so an entry takes few bytes beside its string's own.

    When there are more than ``limit``, the half that was looked up last is kept.
    """

    def __init__(self, limit: int, **kinds: pa.DataType):
        self.limit = limit
        self.words = pa.array([], pa.large_string())
        self.values = {n: pa.array([], k) for n, k in kinds.items()}
        self.used, self.time = np.zeros(0, np.int32), 0

    def find(self, words: pa.Array) -> np.ndarray:
        """The place of each word; -1 where it is not known."""
        at = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.time += 1
        self.used[at[at >= 0]] = self.time
        return at

    def add(self, words: pa.Array, **values: pa.Array) -> None:
        """Words that ``find`` did not know; they come behind all others."""
        self.words = pa.concat_arrays([self.words, words.cast(pa.large_string())])
        self.values = {n: pa.concat_arrays([v, values[n].cast(v.type)]) for n, v in self.values.items()}
        self.used = np.concatenate([self.used, np.full(len(words), self.time, np.int32)])

    def trim(self) -> None:
        if len(self.words) > self.limit:
            keep = pa.array(np.sort(np.argpartition(self.used, -(self.limit // 2))[-(self.limit // 2) :]))
            self.words, self.used = self.words.take(keep), self.used[keep.to_numpy()]
            self.values = {n: v.take(keep) for n, v in self.values.items()}


def tune(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well as by rows, so very long texts cannot pile up in one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def freed() -> None:
    """Give the system back what this worker no longer holds; it may wait for a task while others need the memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, after which the worker keeps none of the task's memory."""

    def released_after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        freed()

    return released_after


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a temporary one only in local mode."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tallymark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut lineage: write ``df`` as a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table made by ``written`` that nothing reads any more."""
    path = getattr(df, "_table_path", None)
    if path:
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def released(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing holds any more; it does so when the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` and ``text`` (null: empty) and the columns named, nothing else: clashing names go."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def n_words(text) -> F.Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))).cast("long")


def offsets(df: DataFrame, part: str, order: list, size: str, name: str, sizes: DataFrame | None = None) -> DataFrame:
    """Running total of ``size`` before each row, for rows in order of ``part`` and then of ``order``.

    Two levels: one row for each part (as many as the partitions that wrote them) gets its offset, then each
    part is summed by itself, so no task sees all rows. ``sizes``: the parts' totals, if they are had for less.
    """
    from pyspark.sql import Window

    parts = df.groupBy(F.col(part).alias("_part")).agg(F.sum(size).alias("_sum")) if sizes is None else sizes.toDF("_part", "_sum")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.join(parts, F.col(part) == F.col("_part"))
    return out.withColumn(name, F.col("_offset") + F.coalesce(F.sum(size).over(inside), F.lit(0))).drop("_part", "_offset")
