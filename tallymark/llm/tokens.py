"""Tokenizing whole texts, and token ids as Parquet list columns.

Method: ids go to Parquet list columns in ascending ``doc_id`` order. The writer uses format version 2, so
int columns are dictionary encoded where that pays and delta packed otherwise; row groups and pages have set
sizes and every file carries column and offset indexes, so a reader of a few documents or of the metadata
columns skips the other pages and columns.

Defined results: null texts are empty and have only the end id. Null ``doc_id`` come first. Rows that repeat
a ``doc_id`` are ordered by text and each has its own place. Very long texts are encoded whole. Columns beside
``doc_id`` and ``text`` are not written. An empty table gives an empty table.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.common import Seen, new_path, offsets, texts, tune

END_ID = 2
#: Chunks that a worker keeps (about 12 MB).
CACHE_ENTRIES = 250_000
#: Bytes of text whose chunks are looked up together.
PART_BYTES = 2 << 20
#: Cells of ids for each partition, from which partitions of about equal numbers of documents are made.
CELLS = 64

FILE_OPTIONS = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "512",
    "compression": "zstd",
}


class Encoder:
    """Ids of texts by the tokenizers library, with each space-led chunk encoded once.

    A byte-level pre-tokenizer never joins a non-space to a space behind it, so a text may be cut before each
    space, unless white space stands on both sides of that space; such texts are encoded whole. The distinct chunks of
    many texts (without their leading spaces) are looked up together, and ids are put together by their places.
    """

    def __init__(self, path: str, max_entries: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        cut = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self.plain_bpe = cut and spec["model"]["type"] == "BPE" and not any(not t or any(map(str.isspace, t)) for t in self.special)
        self.inner, self.max_inner = {}, max_entries // 8
        self.seen = Seen(max_entries, ids=pa.large_binary())
        if self.plain_bpe:
            import regex
            from public_tokenizers import PATTERN

            self.split = regex.compile(PATTERN).findall
            self.tokenize = self.tokenizer.model.tokenize
            kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
            rest = [b for b in range(256) if b not in kept]
            self.bytes_to_chars = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        """One piece of the pre-tokenizer's."""
        chars = word.encode().decode("latin1").translate(self.bytes_to_chars)
        return self.merged(chars)

    def merged(self, chars: str) -> bytes:
        return array("I", [t.id for t in self.tokenize(chars)]).tobytes()

    def cached_inner(self, word: str) -> bytes:
        """A piece without a leading space: line starts, punctuation, white space."""
        found = self.inner.get(word)
        if found is None:
            if len(self.inner) > self.max_inner:
                self.inner.clear()
            found = self.inner[word] = self.word(word)
        return found

    def pieces(self, text: str) -> bytes:
        """A text that starts anywhere, by its pieces."""
        if any(t in text for t in self.special):
            return self.whole(text)
        return b"".join([self.chunk(w[1:]) if w[0] == " " and letters(w[1:]) else self.cached_inner(w) for w in self.split(text)])

    def chunk(self, chunk: str) -> bytes:
        """A chunk behind a space, or one that a line feed leads."""
        if chunk.isascii() and chunk.isalpha():
            return self.merged(self.bytes_to_chars[32] + chunk)
        if letters(chunk):
            return self.word(" " + chunk)
        if chunk[-1:] in ENDS and letters(chunk[:-1]):
            return self.chunk(chunk[:-1]) + self.cached_inner(chunk[-1])
        return self.pieces(chunk if chunk[:1] == "\n" else " " + chunk)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.ids(text), "<u4")

    def ids(self, text: str) -> bytes:
        return self.whole(text) if not self.plain_bpe or BETWEEN.search(text) else b"".join(self.spaced(text))

    def encode_all(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``texts`` (each followed by ``end_id``) and their offsets; distinct chunks are looked up once."""
        flat, size = [], []
        texts = texts.cast(pa.large_string()).fill_null("")
        ends = np.cumsum(pc.binary_length(texts).to_numpy())
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PART_BYTES, "right")))
            for out, x in zip((flat, size), self.part(texts.slice(a, b - a), end_id), strict=True):
                out.append(x)
            a = b
        at = np.concatenate([[0], *size]).cumsum()
        pa.default_memory_pool().release_unused()  # a worker may wait long for its next batch
        return np.concatenate([np.zeros(0, np.uint32), *flat]), at

    def part(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a few texts, and how many each has."""
        if not self.plain_bpe:
            ids = [np.append(self.encode(t), np.uint32(end_id)) for t in texts.to_pylist()]
            return np.concatenate(ids), np.array(list(map(len, ids)))
        # A line feed between two non-blanks is a piece of its own: it leads the chunk behind it.
        other = pc.match_substring_regex(texts, OTHER_SPACE)
        chunks = pc.split_pattern(pc.replace_substring(pc.if_else(other, pa.scalar("", texts.type), texts), "\n", " \n"), " ")
        first = chunks.offsets.to_numpy()[:-1] - chunks.offsets[0].as_py()
        coded = chunks.flatten().dictionary_encode()
        which, words = coded.indices.to_numpy(), coded.dictionary
        place = self.seen.find(words)
        if len(new := np.flatnonzero(place < 0)):
            place[new] = len(self.seen.words) + np.arange(len(new))
            unknown = words.take(pa.array(new))
            found = list(map(self.chunk, unknown.to_numpy(zero_copy_only=False).tolist()))
            self.seen.add(unknown, ids=pa.array(found, pa.large_binary()))
        start, blob = binary(self.seen.values["ids"])
        # No space leads the first chunk of a text. A text with other white space than single blanks is one chunk.
        slow = dict(zip(pc.indices_nonzero(other).to_pylist(), texts.filter(other).to_pylist(), strict=True))
        leads = words.take(pa.array(which[first])).to_numpy(zero_copy_only=False).tolist()
        own = [self.ids(slow[i]) if i in slow else self.pieces(w) for i, w in enumerate(leads)]
        size = np.fromiter(map(len, own), np.int64, len(own)) // 4
        count = np.concatenate([np.diff(start), size])
        start = np.concatenate([start[:-1], len(blob) + np.cumsum(size) - size])
        which = place[which]
        which[first] = len(self.seen.words) + np.arange(len(own))
        each = count[which]
        done = np.cumsum(each)
        ids = np.concatenate([blob, np.frombuffer(b"".join(own), "<u4")])[np.repeat(start[which] - done + each, each) + np.arange(done[-1])]
        n = np.add.reduceat(each, first)
        self.seen.trim()
        return np.insert(ids, np.cumsum(n), np.uint32(end_id)), n + 1

    def spaced(self, text: str) -> Iterator[bytes]:
        first, *chunks = text.split(" ")
        yield self.pieces(first)
        for c in chunks:
            yield self.pieces(" " + c) if c[:1] == "\n" else self.chunk(c)


def binary(values: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets, in ids, and the ids of an array of such."""
    if not len(values):
        return np.zeros(1, np.int64), np.zeros(0, np.uint32)
    _, offsets, data = values.buffers()
    start = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1] // 4
    return start, np.frombuffer(data, "<u4") if data is not None and data.size else np.zeros(0, np.uint32)


#: White space other than single blanks and line feeds between non-blanks.
OTHER_SPACE = "\\A[ \n]|[ \n]\\z|[ \n][ \n]|[\t\v\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: A space between white space and white space or the end.
BETWEEN = re.compile(r"\s (?:\s|\Z)")
ENDS = frozenset(".,")


def letters(word: str) -> bool:
    """Letters alone, of the scripts whose letters no two Unicode versions disagree about."""
    return word.isalpha() and (word.isascii() or max(word) < "\u0250")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` (with the end id) of each row of ``docs``, in the given order of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer_path)
        for batch in batches:
            flat, at = e.encode_all(batch.column("text"), end_id)
            ids = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat.view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at)), ids], ["doc_id", "n_tokens", "ids"])

    tune(docs.sparkSession)
    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def ranged(docs: DataFrame) -> DataFrame:
    """``docs`` in partitions of ascending ``doc_id``, null ids first.

    Ids are counted in cells of equal width, from the ``doc_id`` column alone, and cells are dealt to partitions in
    order; so texts are read once, where a range partitioning would read them to sample ids. A cell that holds more than
    a partition's share is cut into cells again, and so on, so a few far ids do not put all others together.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None:
        return docs.coalesce(1)
    whole = lambda x: F.lit(str(x)).cast("decimal(20,0)")
    cells, width, count, levels = n * CELLS, (high - low) // (n * CELLS) + 1, None, []
    place = F.col("doc_id").cast("decimal(20,0)") - whole(low)
    cell = F.call_function("div", place, whole(width)).cast("int")  # a quotient with a fraction could round up
    share, inside = 0, F.col("doc_id").isNotNull()
    while True:
        count = np.zeros(cells, np.int64)
        for r in docs.where(inside).groupBy(cell.alias("cell")).count().collect():  # at most ``cells`` rows
            count[r["cell"]] = r["count"]
        share = share or -(-int(count.sum()) // n)
        heavy = np.flatnonzero(count > share) if width > 1 else np.zeros(0, np.int64)
        number = np.full(cells, -1, np.int32)
        number[heavy] = np.arange(len(heavy))
        levels.append((cell, count, heavy, number))
        if not len(heavy):
            break
        each = max(2, n * CELLS // len(heavy))
        cells, finer = len(heavy) * each, -(-width // each)
        index = F.get(F.lit(number), cell)
        inside, place = inside & (index >= 0), place - cell.cast("decimal(20,0)") * whole(width)
        cell, width = index * each + F.call_function("div", place, whole(finer)).cast("int"), finer
    # From the finest level up: where each cell starts among all ids, and so its partition.
    part, starts, total = None, np.zeros(1, np.int64), int(levels[0][1].sum())
    found = []
    for cell, count, heavy, number in levels:
        rows = count.reshape(len(starts), -1)
        start = (starts[:, None] + np.cumsum(rows, 1) - rows).ravel()
        found.append((cell, start, number))
        starts = start[heavy]
    for cell, start, number in reversed(found):
        own = F.get(F.lit(np.minimum(start * n // max(total, 1), n - 1).astype(np.int32)), cell)
        part = own if part is None else F.when(F.get(F.lit(number), cell) >= 0, part).otherwise(own)
    return docs.repartitionById(n, F.coalesce(part, F.lit(0)).cast("int"))


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID) -> None:
    """Write the ids of ``docs`` in ascending ``doc_id`` order. ``place`` grows from row to row; its high bits number the file."""
    ordered = ranged(texts(docs)).sortWithinPartitions("doc_id", "text")
    out = encoded(ordered, tokenizer_path, end_id).select("doc_id", F.monotonically_increasing_id().alias("place"), "n_tokens", "ids")
    out.write.options(**FILE_OPTIONS).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, place long, n_tokens long, ids array<int>").parquet(path)


def token_report(spark: SparkSession, path: str) -> DataFrame:
    """From the files: ``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            at, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
            sums = [crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            n = np.diff(at).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("place"), pa.array(n), pa.array(sums, pa.int64())], ["doc_id", "place", "n_tokens", "ids_crc32"])

    tune(spark)
    files = read_tokens(spark, path)
    rows = files.select("doc_id", "place", "ids").mapInArrow(run, "doc_id long, place long, n_tokens long, ids_crc32 long")
    part = F.shiftright("place", 33)
    sizes = files.groupBy(part.alias("part")).agg(F.sum("n_tokens").alias("size"))  # reads the pages of two columns
    placed = offsets(rows.withColumn("part", part), "part", ["place"], "n_tokens", "start", sizes)
    return placed.select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_report(spark, path)
