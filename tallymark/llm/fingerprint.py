"""Document fingerprints as invertible Bloom lookup sketches of paragraphs. DataFrame and SQL functions only.

Method: a text's paragraphs become 64-bit digests. Digests are dealt to shards (about ``SHARD`` in each) by hash,
and each shard is a sketch of three subtables: every digest goes into one cell of each, and a cell holds how
many digests it has, their exclusive or, and that of their checks. To compare two texts their sketches are
subtracted cell by cell, so common paragraphs vanish; then cells that hold one digest give it up, round after
round, until all cells are empty. The digests given up are those of the paragraphs that differ. If the cells do not
empty, sketches of four times the cells are made and peeled; after the last size the digests themselves are compared.
The likeness is Jaccard's: with ``d`` differing of ``a`` and ``b`` paragraphs, ``(a + b - d) / (a + b + d)``.

A paragraph is a line that is not blank; a line of more than ``LONG_LINE`` characters is cut behind its sentences, and
a sentence that is still longer behind the words whose hash says so (a text without blanks stays one piece, so an edit
of it leaves nothing alike). Repeated paragraphs count once. The fingerprint starts with the number of characters and a
hash of the whole text, so different texts differ in it; its cells are a whole sketch, and two stored fingerprints can
be subtracted and peeled without the texts (``likeness_of_prints``).

Defined results: null texts are empty; two texts without paragraphs have likeness 1, one such text and another 0.
The next document is that of the next greater ``doc_id`` (null after all others); of rows that repeat an id the
least text counts as the next one's. Very long texts have more shards, not larger ones. Other columns than ``doc_id``
and ``text`` are not looked at. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymark.llm.common import texts, written

LONG_LINE, SHARD, CUT = 240, 8, 40
#: Cells of a subtable: first try, and each try after a failure. Texts that are not versions of one another start at the second.
SIZES, ROUNDS = (4, 12, 48), 14
#: Documents up to which the table of successors (24 bytes each) is sent to every executor; beyond it, a join.
BROADCAST_IDS = 1_000_000

#: SQL: a long piece cut behind the words whose hash says so, about one in ``CUT``.
BY_WORDS = f"split(array_join(transform(split(s, ' '), w -> if(pmod(xxhash64(w), {CUT}) = 0, concat(w, '\\n'), w)), ' '), '\\n ?')"
PARAGRAPHS = (
    f"flatten(transform(split(%s, '\\n'), l -> if(char_length(l) > {LONG_LINE}, "
    f"flatten(transform(split(l, '(?<=[.!?]) '), s -> if(char_length(s) > {LONG_LINE}, {BY_WORDS}, array(s)))), array(l))))"
)


def digests(text: str) -> str:
    """SQL: the distinct digests of a text's paragraphs."""
    return f"array_distinct(transform(filter({PARAGRAPHS % text}, p -> length(trim(p)) > 0), p -> xxhash64(p)))"


def shards(*keys: str) -> str:
    return f"cast(pow(2, greatest(0, ceil(log2(greatest(1, {', '.join(f'size({k})' for k in keys)}) / {SHARD}D)))) as int)"


def shard_of(key: str, n: str) -> str:
    return f"pmod(xxhash64({key}, 7), {n})"


EMPTY = "named_struct('n', 0, 'k', 0L, 'h', 0L)"


def placed(key: str, m: int, step: int, *more: str) -> str:
    """SQL: a digest with its check and its cell in each of three subtables of ``m`` cells."""
    cells = ", ".join(f"'{c}', cast(pmod(xxhash64({key}, {i}), {m}) as int) + {i * step}" for i, c in enumerate("abc"))
    return f"named_struct('k', {key}, 'h', xxhash64({key}, 99), {''.join(more)}{cells})"


def sketch(digests: str, m: int, n: str = "1") -> str:
    """SQL: the cells, from digests with their places. ``n``: how often a digest ``e`` counts (-1: it is taken away)."""
    return "concat(" + ", ".join(
        f"transform(sequence(0, {m - 1}), u -> aggregate(filter({digests}, e -> e.{c} = u), {EMPTY}, (z, e) -> named_struct('n', z.n + {n}, 'k', z.k ^ e.k, 'h', z.h ^ e.h)))"
        for c in "abc"
    ) + ")"


def minus(a: str, b: str) -> str:
    """SQL: sketch ``a`` less sketch ``b``."""
    return f"zip_with({a}, {b}, (x, y) -> named_struct('n', x.n - y.n, 'k', x.k ^ y.k, 'h', x.h ^ y.h))"


NO_DIGESTS = "cast(array() as array<struct<k:bigint,n:int>>)"


def peeled(less: str, m: int, keep: bool = False) -> str:
    """SQL: what a difference of sketches of ``3 m`` cells holds, found by peeling: how many digests, or (``keep``) the
    digests themselves with the side that has them (1 or -1); null if the cells do not empty."""
    pure = "abs(x.n) = 1 AND x.h = xxhash64(x.k, 99)"
    found = f"transform(array_distinct(transform(filter(s.c, x -> {pure}), x -> named_struct('k', x.k, 'n', x.n))), f -> {placed('f.k', m, m, chr(39), 'n', chr(39), ', f.n, ')})"
    # A cell is asked for its own subtable's place alone.
    at = f"if(i < {m}, filter(p, e -> e.a = i), if(i < {2 * m}, filter(p, e -> e.b = i), filter(p, e -> e.c = i)))"
    taken = f"aggregate({at}, x, (y, e) -> named_struct('n', y.n - e.n, 'k', y.k ^ e.k, 'h', y.h ^ e.h))"
    more = "concat(s.d, transform(p, f -> named_struct('k', f.k, 'n', f.n)))" if keep else "s.d + size(p)"
    # A round that finds nothing is the last one that looks, and drops the cells, which every later round would copy.
    filled = "exists(s.c, x -> x.n != 0 OR x.k != 0 OR x.h != 0)"
    step = (
        f"if(s.go, element_at(transform(array({found}), p -> if(size(p) = 0, named_struct('c', slice(s.c, 1, 0), 'd', s.d, 'go', false, 'ok', NOT {filled}), "
        f"named_struct('c', transform(s.c, (x, i) -> {taken}), 'd', {more}, 'go', true, 'ok', false))), 1), s)"
    )
    return (
        f"aggregate(sequence(1, {ROUNDS}), named_struct('c', {less}, 'd', {NO_DIGESTS if keep else '0'}, 'go', true, 'ok', false), (s, r) -> {step}, "
        f"s -> if(if(s.go, NOT {filled}, s.ok), s.d, null))"
    )


def differing(a: str, b: str, m: int, keep: bool = False) -> str:
    """SQL: ``peeled`` of the sketch of one list of digests less that of another, taken cell by cell in one pass."""
    both = "concat(" + ", ".join(f"transform({keys}, q -> {placed('q', m, 0, chr(39), 'n', chr(39), f', {n}, ')})" for n, keys in ((1, a), (-1, b))) + ")"
    return f"element_at(transform(array({both}), o -> {peeled(sketch('o', m, 'e.n'), m, keep)}), 1)"


def by_shard(a: str, b: str, inside: str) -> str:
    """SQL: a list of ``inside`` of each shard's digests ``v.a`` and ``v.b``."""
    shard = f"element_at(transform(array(named_struct('a', filter({a}, k -> {shard_of('k', 'w')} = g), 'b', filter({b}, k -> {shard_of('k', 'w')} = g))), v -> {inside}), 1)"
    return f"element_at(transform(array({shards(a, b)}), w -> transform(sequence(0, w - 1), g -> {shard})), 1)"


def recovered(a: str, b: str, sizes: tuple[int, ...] = SIZES) -> str:
    """SQL: the digests that only one of two texts has, each with its side (1: the first, -1: the second)."""
    tries = ", ".join(differing("v.a", "v.b", m, True) for m in sizes)
    side = lambda x, y, n: f"transform(array_except({x}, {y}), k -> named_struct('k', k, 'n', {n}))"
    exact = f"concat({side('v.a', 'v.b', 1)}, {side('v.b', 'v.a', -1)})"
    return f"flatten({by_shard(a, b, f'coalesce({tries}, {exact})')})"


def jaccard(total: str, d: str) -> str:
    """SQL: likeness of two texts that have ``total`` digests together and differ in ``d``."""
    return f"element_at(transform(array(named_struct('t', {total}, 'd', {d})), o -> if(o.t = 0, 1D, (o.t - o.d) / cast(o.t + o.d as double))), 1)"


def likeness(a: str, b: str, sizes: tuple[int, ...] = SIZES) -> str:
    """SQL: likeness of two texts from the columns of their digests."""
    tries = ", ".join(differing("v.a", "v.b", m) for m in sizes)
    exact = "size(array_except(v.a, v.b)) + size(array_except(v.b, v.a))"
    return jaccard(f"size({a}) + size({b})", f"aggregate({by_shard(a, b, f'coalesce({tries}, {exact})')}, 0, (t, x) -> t + x)")


def printed(text: str, keys: str) -> str:
    """SQL: the fingerprint of a text: characters, hash of the text, and the cells of its shards in hexadecimal."""
    m = SIZES[0]
    one = "if(x.n = 0, '', concat(hex(x.n), ':', hex(x.k), ':', hex(x.h)))"
    inside = f"filter({keys}, k -> {shard_of('k', 'w')} = g)"
    cells = f"element_at(transform(array(transform({inside}, q -> {placed('q', m, 0)})), o -> transform({sketch('o', m)}, x -> {one})), 1)"
    each = f"transform(sequence(0, w - 1), g -> array_join({cells}, ','))"
    return f"concat_ws(';', char_length({text}), hex(xxhash64({text})), array_join(element_at(transform(array({shards(keys)}), w -> {each}), 1), '|'))"


def read_back(fingerprint: str) -> str:
    """SQL: the shards of a printed fingerprint, each a list of cells."""
    number = lambda i: f"cast(conv(element_at(split(x, ':'), {i}), 16, -10) as bigint)"
    cell = f"if(x = '', {EMPTY}, named_struct('n', cast({number(1)} as int), 'k', {number(2)}, 'h', {number(3)}))"
    return f"transform(split(substring_index({fingerprint}, ';', -1), '[|]'), s -> transform(split(s, ','), x -> {cell}))"


def likeness_of_prints(a: str, b: str) -> str:
    """SQL: likeness of two texts from their printed fingerprints alone; null where peeling needs larger sketches.

    The shards of the longer text are folded: as numbers of shards are powers of two, shard ``g`` of ``w`` is the sum of
    those whose numbers leave ``g``.
    """
    m = SIZES[0]
    none = f"array_repeat({EMPTY}, {3 * m})"
    plus = "zip_with(t, s, (x, y) -> named_struct('n', x.n + y.n, 'k', x.k ^ y.k, 'h', x.h ^ y.h))"
    fold = lambda side: f"aggregate(filter(transform(o.{side}, (s, j) -> named_struct('s', s, 'j', j)), e -> pmod(e.j, least(size(o.a), size(o.b))) = g), {none}, (t, e) -> element_at(transform(array(e.s), s -> {plus}), 1))"
    each = f"transform(sequence(0, least(size(o.a), size(o.b)) - 1), g -> {peeled(minus(fold('a'), fold('b')), m)})"
    count = lambda side: f"aggregate(flatten(o.{side}), 0, (t, x) -> t + x.n) div 3"  # noqa: E731  every digest is in three cells
    d = f"aggregate({each}, 0, (t, x) -> t + x)"
    return f"element_at(transform(array(named_struct('a', {read_back(a)}, 'b', {read_back(b)})), o -> {jaccard(count('a') + ' + ' + count('b'), d).replace('o ->', 'z ->').replace('o.t', 'z.t').replace('o.d', 'z.d')}), 1)"


def successors(docs: DataFrame) -> DataFrame:
    """``id``, ``next`` (null ids as they are) and ``need``, the characters that ``id``'s edited text takes."""
    ids = texts(docs).groupBy("doc_id").agg(F.floor(F.max(F.length("text")) / 4).cast("int").alias("need"))
    ids = ids.withColumn("last", F.col("doc_id").isNull()).repartitionByRange("last", "doc_id")
    ids = written(ids.select("doc_id", "last", "need", F.spark_partition_id().alias("part")), "ids")
    # One row for each part of the range: its least id, and so the id behind the part before it.
    firsts = ids.groupBy("part").agg(F.min(F.struct("last", "doc_id")).alias("first"))
    order = Window.orderBy("part")
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(order), F.first("first").over(order)).alias("behind"))
    inside = Window.partitionBy("part").orderBy("last", "doc_id")
    found = ids.join(firsts, "part").withColumn("next", F.coalesce(F.lead(F.struct("last", "doc_id")).over(inside), F.col("behind")))
    return found.select(F.col("doc_id").alias("id"), F.col("next.doc_id").alias("next"), "need")


def compared(docs: DataFrame) -> DataFrame:
    """Fingerprints and likenesses of each row of ``docs``, its edited text and its next document, and the digests of
    the paragraphs that the edit ``removed`` and ``added``."""
    after = written(successors(docs), "successors")
    few = after.count() <= BROADCAST_IDS
    d = texts(docs).withColumn("keys", F.expr(digests("text")))
    heads = d.join(F.broadcast(after) if few else after, F.col("doc_id").eqNullSafe(F.col("next")))
    heads = heads.select("id", F.struct(F.col("text").substr(F.lit(1), F.col("need")).alias("head"), F.col("keys").alias("next_keys")).alias("n"))
    repeats = heads.groupBy("id").agg(F.min("n").alias("n")).select("id", "n.head", "n.next_keys")
    d = texts(docs).join(repeats, F.col("doc_id").eqNullSafe(F.col("id")), "left")
    d = d.withColumn("n_chars", F.length("text").cast("long")).withColumn("cut", F.floor(F.col("n_chars") / 4).cast("int"))
    edited = F.concat(F.col("text").substr(F.lit(1), (F.col("n_chars") - F.col("cut")).cast("int")), F.coalesce(F.col("head"), F.lit("")).substr(F.lit(1), F.col("cut")))
    d = d.withColumn("edited", edited).withColumn("keys", F.expr(digests("text")))
    d = d.withColumn("edited_keys", F.expr(digests("edited"))).withColumn("next_keys", F.coalesce("next_keys", F.array().cast("array<bigint>")))
    return d.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.expr(printed("text", "keys")).alias("fingerprint"),
        F.expr(printed("edited", "edited_keys")).alias("edited_fingerprint"),
        F.expr(recovered("keys", "edited_keys")).alias("_differing"),
        F.expr(likeness("keys", "next_keys", SIZES[1:])).alias("near_next"),
        (F.size("keys") + F.size("edited_keys")).alias("_total"),
    ).select(
        *["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint"],
        F.expr(jaccard("_total", "size(_differing)")).alias("near_edited"),
        "near_next",
        F.expr("transform(filter(_differing, x -> x.n > 0), x -> x.k)").alias("removed"),
        F.expr("transform(filter(_differing, x -> x.n < 0), x -> x.k)").alias("added"),
    )


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(spark.read.parquet(f"{sf_dir}/documents.parquet"))
