"""Deduplication in fixed windows: a sighting counts if the key's last counted sighting has expired.

Only the key, the time and what else a decision needs leave the rows; what counts comes back and is joined to them.

Fixed windows need no more than the seconds in which a key has events. These are gathered by key and block of time, so
the events of one very frequent key are dealt out over its blocks, and then walked in order of the blocks with jumps from
one counted second to the next: a key brings at most as many seconds as its time has, whatever the number of its events.

Where a decision needs every event (a change of salts, claims that failed sends give back), a key's events meet sorted in
one task, and a fold that holds the key's expiries passes over them. What it decides depends on all earlier events of the
key, which no built-in aggregate or window expresses without holding them; it runs in Python over Arrow batches.

Rows without a key all count. Rows without a time never count and set nothing. Of rows of one key and second the least
``seq`` comes first; rows of equal ``t`` and ``seq`` are taken one after the other.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.config import Settings, is_placeholder
from tallymark.functions.expressions import hashed


def scope(platform, campaign, creative, roku_campaign, roku_creative) -> Column:
    """Campaign and creative, and the native ids where a native tag has both."""
    native = (platform == "roku") & (roku_campaign != "") & (roku_creative != "")
    both = F.concat_ws("|", campaign, creative)
    return F.when(native, F.concat_ws("|", both, roku_campaign, roku_creative)).otherwise(both)


def dedup_key(ifa_present, ifa_hash, scope_key, connecting_ip, now, settings: Settings) -> Column:
    """By device where it is known, else by the hour's hash of the connection; null (always counted) if neither is."""
    pepper = settings.ip_salt.strip() if not is_placeholder(settings.ip_salt) else (settings.hash_salt or "")
    hour = F.floor(now / 3600).cast("string")
    coarse = hashed(pepper, F.concat(F.lit("ip:"), connecting_ip, F.lit(":"), hour))
    known = F.when(ifa_present, F.concat_ws("|", ifa_hash, scope_key))
    if not settings.cap_unattributable:
        return known
    return known.when(F.coalesce(connecting_ip, F.lit("")) != "", F.concat_ws("|", coarse, scope_key))


State = tuple[int, ...]
#: Lifetimes in a block of time.
BLOCK = 4
#: Earlier than any event.
BEFORE = -(1 << 62)


def spread(key: str) -> Column:
    """``key``, and for rows without one a value of their own, so that they do not meet in one partition."""
    return F.coalesce(F.col(key).cast("string"), F.concat(F.lit("\0"), F.col("seq").cast("string")))


def in_order(df: DataFrame, *order: str) -> DataFrame:
    """Adds ``_nth``, the number of a row among those of its ``_key``, which then follow one another in one task.

    A window needs that of its input and so keeps it. A repartition by ``_key`` does not: behind a join by ``_key`` Spark
    leaves it out, and when that join turns out to be a broadcast, reads the shuffle below it by the tasks that wrote it.
    """
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy("_key").orderBy(*order)))


def folded(df: DataFrame, key: str, name: str, start: State, fold: Callable, *columns: str) -> DataFrame:
    """Adds the Boolean column ``name``: what ``fold`` says of each event of a key, in order of ``t`` and ``seq``.

    ``fold(state, rows, flags, a, b)`` sets the flags of rows ``a`` to ``b`` and gives the next state; ``rows`` has
    ``t`` and ``columns`` as lists.
    """
    names = ["_key", "t", "seq", *columns]
    narrow = df.select(F.col(key).cast("string").alias("_key"), "t", "seq", *columns).where("_key is not null and t is not null")
    ordered = in_order(narrow, *names[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start
        for batch in batches:
            ends = pc.run_end_encode(batch.column("_key")).run_ends.to_pylist()
            rows = {c: batch.column(c).to_pylist() for c in ("t", *columns)}
            nth = batch.column("_nth").to_numpy()
            flags, a = [False] * batch.num_rows, 0
            for b in ends:
                if nth[a] == 1:
                    state = start
                state = fold(state, rows, flags, a, b)
                a = b
            yield batch.select(names).filter(pa.array(flags, pa.bool_()))

    found = ordered.mapInArrow(run, narrow.schema).groupBy(*[F.col(c).alias(f"_f{i}") for i, c in enumerate(names)]).agg(F.count("*").alias("_times"))
    return marked(df, key, name, found, ["t", "seq", *columns])


def marked(df: DataFrame, key: str, name: str, found: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``name``: true for ``_times`` of the rows that are equal to a row of ``found`` (``_f0``: the key), and without a key."""
    d = df.withColumn("_f", spread(key))
    same = F.col("_f") == F.col("_f0")
    for i, c in enumerate(columns):
        same = same & F.col(c).eqNullSafe(F.col(f"_f{i + 1}"))
    d = d.join(found, same, "left")
    nth = F.row_number().over(Window.partitionBy("_f", *columns).orderBy("seq"))
    flag = F.col(key).isNull() | F.coalesce(nth <= F.col("_times"), F.lit(False))
    return d.withColumn(name, F.col("t").isNotNull() & flag).drop("_f", "_times", *[f"_f{i}" for i in range(len(columns) + 1)])


def counted_seconds(df: DataFrame, key: str, ttl: int, seen: DataFrame | None = None) -> DataFrame:
    """``_f0`` (the key) and ``_f1`` (the second) of each event that counts. ``seen``: ``key`` and ``exp`` of the store at the start."""
    d = df.select(F.col(key).cast("string").alias("_key"), F.col("t").cast("bigint").alias("t")).where("_key is not null and t is not null")
    block = F.floor(F.col("t") / (BLOCK * max(ttl, 1))).alias("_block")
    d = d.groupBy("_key", block).agg(F.sort_array(F.collect_set("t")).alias("seconds"))
    if seen is None:
        d = d.withColumn("_exp", F.lit(None).cast("bigint"))
    else:
        held = seen.groupBy(F.col("key").alias("_held")).agg(F.max("exp").cast("bigint").alias("_exp"))
        d = d.join(held, F.col("_key") == F.col("_held"), "left").drop("_held")
    ordered = in_order(d, "_block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = BEFORE
        for batch in batches:
            keys, firsts = [], []
            lists = batch.column("seconds")
            seconds, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
            columns = (batch.column(c).to_pylist() for c in ("_key", "_exp", "_nth"))
            for i, (k, exp, nth) in enumerate(zip(*columns, strict=True)):
                if nth == 1:
                    end = BEFORE if exp is None else exp
                own = seconds[offsets[i] : offsets[i + 1]]
                at = int(np.searchsorted(own, end))
                while at < len(own):
                    keys.append(k)
                    firsts.append(int(own[at]))
                    end = firsts[-1] + ttl
                    at = max(at + 1, int(np.searchsorted(own, end)))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(firsts, pa.int64())], ["_f0", "_f1"])

    return ordered.select("_key", "seconds", "_exp", "_nth").mapInArrow(run, "_f0 string, _f1 long")


def fixed_fold(ttl: int) -> Callable:
    """State: the expiry."""

    def fold(state: State, rows: dict, flags: list, a: int, b: int) -> State:
        t, (end,) = rows["t"], state
        i = bisect_left(t, end, a, b)
        while i < b:
            flags[i], end = True, t[i] + ttl
            i = bisect_left(t, end, i + 1, b)
        return (end,)

    return fold


def rotation_fold(ttl: int) -> Callable:
    """State: the expiries of the old and of the new key."""

    def fold(state: State, rows: dict, flags: list, a: int, b: int) -> State:
        old, new = state
        for i in range(a, b):
            t, after = rows["t"][i], rows["after"][i]
            flags[i] = not (old > t or (after and new > t))
            if after and new <= t:
                new = t + ttl
            elif not after and old <= t:
                old = t + ttl
        return old, new

    return fold


def claim_fold(ttl: int) -> Callable:
    """State: the expiry of the claim, the least number where a failed send gave it back."""

    def fold(state: State, rows: dict, flags: list, a: int, b: int) -> State:
        t, (end,) = rows["t"], state
        i = bisect_left(t, end, a, b)
        while i < b:
            flags[i], end = True, t[i] + ttl if rows["sent"][i] else BEFORE
            i = bisect_left(t, end, i + 1, b)
        return (end,)

    return fold


def seeded(df: DataFrame, key: str, ttl: int, seen: DataFrame | None = None) -> DataFrame:
    """Adds ``is_seed``: whether an event sets its key. ``seen``: ``key`` and ``exp`` of the store at the start.

    Of the rows of a second that counts the first sets the key; with a lifetime of nothing all do.
    """
    found = counted_seconds(df, key, ttl, seen).withColumn("_times", F.lit(1 if ttl > 0 else (1 << 31) - 1))
    return marked(df, key, "is_seed", found, ["t"])


def fixed_window(df: DataFrame, key: str, ttl: int, seen: DataFrame | None = None, alias: str | None = None) -> DataFrame:
    """Adds ``is_first`` and ``is_seed``. Needs ``t`` (seconds) and ``seq``; rows of a null key all count.

    ``alias`` is the key under the previous salt: an event is a repeat while that lives in ``seen``, and sets its
    own key all the same.
    """
    d = seeded(df, key, ttl, seen)
    first = F.col("is_seed")
    if alias is not None and seen is not None:
        held = seen.groupBy(F.col("key").alias("_key")).agg(F.max("exp").alias("_alias_exp"))
        d = d.withColumn("_alias", spread(alias)).join(held, F.col("_alias") == F.col("_key"), "left")
        first = first & (F.col("_alias_exp").isNull() | (F.col("_alias_exp") <= F.col("t")))
    return d.withColumn("is_first", first).drop("_key", "_alias", "_alias_exp")


def rotating(df: DataFrame, device: str, ttl: int) -> DataFrame:
    """Adds ``is_first`` under a change of salts. ``after`` says whether an event bears the new salt.

    Before the change only the old key is asked and set. After it an event is a repeat if either key lives; a new
    key that does not live is set for a full lifetime, even where the old one made the event a repeat.
    """
    return folded(df, device, "is_first", (BEFORE, BEFORE), rotation_fold(ttl), "after")


def claims(df: DataFrame, key: str, ttl: int) -> DataFrame:
    """Adds ``is_claimed``: whether an attempt got the claim on its key. ``sent`` says if its send succeeded; a
    failed send gives the claim back, so the next attempt runs."""
    return folded(df, key, "is_claimed", (BEFORE,), claim_fold(ttl), "sent")


def live_keys(df: DataFrame, key: str, ttl: int, as_of: int, seen: DataFrame | None = None) -> DataFrame:
    """The store at ``as_of``: ``key`` and its expiry, without those that are purged. Rows that say themselves whether
    they set their key (``is_seed``) are not walked again."""
    if "is_seed" in df.columns:
        set_at = df.where(F.col("is_seed") & F.col(key).isNotNull()).select(F.col(key).alias("key"), "t")
    else:
        set_at = counted_seconds(df, key, ttl, seen).toDF("key", "t")
    new = set_at.groupBy("key").agg((F.max("t") + ttl).alias("exp"))
    if seen is not None:
        new = new.union(seen.select("key", "exp")).groupBy("key").agg(F.max("exp").alias("exp"))
    return new.where(F.col("exp") > as_of)


def store_size(keys: DataFrame) -> DataFrame:
    """How many keys the store holds."""
    return keys.agg(F.count("*").alias("keys"))


def erase_prefix(keys: DataFrame, key: str, prefix: str) -> DataFrame:
    """What is left of ``keys`` without those that start with ``prefix``, taken as it is; an empty prefix erases nothing."""
    return keys.where(~F.col(key).startswith(prefix)) if prefix else keys
