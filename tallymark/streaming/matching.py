"""Calls matched with impressions as both stream in: one row for each call, with its candidates counted first.

The state of a store has, by second, how many impressions it holds and what matching needs of them; and the calls that
wait. A call waits until the watermark has passed its arrival and its start, so every impression that came no later than
the allowed delay is there. Then its window is counted by minutes, and by seconds at its two ends; only a call with at most
as many candidates as the ceiling reads impressions, and of those only the seconds that have any. Whatever the number of a
store's impressions, a call reads a bounded number of counts and at most as many impressions as the ceiling.

Rows go on with their candidates as an array, and the batch operator's expressions score them, so the result is the
batch's. Calls whose window holds nothing come too, at the watermark. Impressions are kept for the window and ``keep``
seconds more, so calls that are reported long after their start, the longest that validation lets through, still find
those of their time. Rows that arrive later than the delay behind the others are dropped, as all streams here do.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tallymark.config import Settings
from tallymark.operators import attribution

#: What an impression brings besides its second; as in ``schemas.RECENT``.
HELD = ("seq", "ip", "rida", "hh_id", "region", "city", "postal", "lmt")
_HELD = "seq bigint, ip string, rida string, hh_id string, region string, city string, postal string, lmt boolean"
_PAIR = "ts bigint, imp_seq bigint, ip string, rida string, hh_id string, region string, city string, postal string, lmt boolean"
OUT = f"store_key string, call_seq bigint, call_ts bigint, caller_state string, t bigint, candidates bigint, pairs array<struct<{_PAIR.replace(' bigint', ':bigint').replace(' string', ':string').replace(' boolean', ':boolean')}>>"
MINUTE = 60


class Matcher(StatefulProcessor):
    """The state of one store."""

    def __init__(self, window: int, ceiling: int, keep: int):
        self.window, self.ceiling, self.keep = window, ceiling, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.minutes = handle.getMapState("minutes", "minute bigint", "n bigint")
        self.seconds = handle.getMapState("seconds", "second bigint", "n bigint")
        self.rows = handle.getMapState("rows", "second bigint, place bigint", _HELD)
        self.waiting = handle.getMapState("waiting", "due bigint", "n bigint")
        self.calls = handle.getMapState("calls", "due bigint, place bigint", "call_seq bigint, call_ts bigint, caller_state string, t bigint")

    @staticmethod
    def count(state, key: int) -> int:
        held = state.getValue((key,))
        return 0 if held is None else held[0]

    def add(self, rows: pd.DataFrame) -> None:
        """Impressions, second by second."""
        for second, own in rows.groupby("ts", sort=True):
            second = int(second)
            n = self.count(self.seconds, second)
            for i, row in enumerate(own[list(HELD)].itertuples(index=False, name=None)):
                self.rows.updateValue((second, n + i), (int(row[0]), *row[1:7], None if row[7] is None else bool(row[7])))
            self.seconds.updateValue((second,), (n + len(own),))
            minute = second // MINUTE
            self.minutes.updateValue((minute,), (self.count(self.minutes, minute) + len(own),))
            self.handle.registerTimer((second // MINUTE * MINUTE + MINUTE + self.window + self.keep) * 1000)

    def matched(self, key: str, call: tuple) -> tuple:
        call_seq, call_ts, caller_state, t = call
        start = call_ts - self.window
        first, last = -(-start // MINUTE), (call_ts + 1) // MINUTE  # whole minutes of the window: from first, before last
        edges = range(start, call_ts + 1) if last <= first else [*range(start, first * MINUTE), *range(last * MINUTE, call_ts + 1)]
        minutes = {m: self.count(self.minutes, m) for m in range(first, last)}
        held = {s: self.count(self.seconds, s) for s in edges if self.count(self.minutes, s // MINUTE)} if edges else {}
        n, pairs = sum(minutes.values()) + sum(held.values()), []
        if 0 < n <= self.ceiling:
            for m, k in minutes.items():
                held |= {s: self.count(self.seconds, s) for s in range(m * MINUTE, (m + 1) * MINUTE)} if k else {}
            for second, k in sorted(held.items()):
                pairs += [(second, *self.rows.getValue((second, i))) for i in range(k)]
        return (key, call_seq, call_ts, caller_state, t, n, pairs)

    def answers(self, key: str, due: int) -> Iterator[pd.DataFrame]:
        """The calls that wait for a second."""
        names = ["store_key", "call_seq", "call_ts", "caller_state", "t", "candidates", "pairs"]
        pair = [c.split()[0] for c in _PAIR.split(", ")]
        for i in range(self.count(self.waiting, due)):
            row = self.matched(key, self.calls.getValue((due, i)))
            self.calls.removeKey((due, i))
            yield pd.DataFrame([(*row[:6], [dict(zip(pair, p, strict=True)) for p in row[6]])], columns=names)
        self.waiting.removeKey((due,))

    def forget(self, minute: int) -> None:
        """The impressions of a minute that no call can reach any more."""
        for second in range(minute * MINUTE, (minute + 1) * MINUTE) if self.minutes.containsKey((minute,)) else ():
            for i in range(self.count(self.seconds, second)):
                self.rows.removeKey((second, i))
            self.seconds.removeKey((second,))
        self.minutes.removeKey((minute,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            is_call = frame["is_call"].astype(bool)
            self.add(frame[~is_call])
            for r in frame[is_call].itertuples(index=False):
                due = int(max(r.ts, r.t))
                place = self.count(self.waiting, due)
                self.calls.updateValue((due, place), (int(r.call_seq), int(r.ts), r.caller_state, int(r.t)))
                self.waiting.updateValue((due,), (place + 1,))
                self.handle.registerTimer((due + 1) * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A timer stands one second behind what waits for it: a call, or a minute of impressions."""
        at = expiredTimerInfo.getExpiryTimeInMs() // 1000
        yield from self.answers(key[0], at - 1)
        over = at - self.window - self.keep
        if over % MINUTE == 0:
            self.forget(over // MINUTE - 1)

    def close(self) -> None:
        pass


def matched(calls: DataFrame, recent: DataFrame, settings: Settings = Settings(), delay: str = "10 minutes", keep: int = attribution.MAX_AGE) -> DataFrame:
    """Each streamed call with ``candidates``, ``best``, ``confidence``, ``gate``, ``matched`` and ``device_ids``.

    ``calls``: ``call_seq``, ``store_key``, ``call_ts``, ``caller_state`` and ``t``, the second of arrival (not null;
    ``call_seq`` is unique). ``recent``: ``schemas.RECENT``, whose ``ts`` is the second of arrival. Both are watermarked by
    arrival, and the slower of the two decides, so a pause of the impressions holds the calls back.
    """
    # Numbers that the other kind of row lacks are 0: with nulls among them they would come as floating point.
    blank = [F.lit(0).cast(k).alias(c) if k == "bigint" else F.lit(None).cast(k).alias(c) for c, k in (p.split() for p in _HELD.split(", "))]
    at = lambda c: F.timestamp_seconds(c).alias("_at")
    c = calls.where("store_key is not null").select("store_key", F.lit(True).alias("is_call"), F.col("call_ts").cast("bigint").alias("ts"), "call_seq", "caller_state", F.col("t").cast("bigint").alias("t"), *blank, at("t"))
    r = recent.select("store_key", F.lit(False).alias("is_call"), F.col("ts").cast("bigint").alias("ts"), F.lit(0).cast("bigint").alias("call_seq"), F.lit(None).cast("string").alias("caller_state"), F.lit(0).cast("bigint").alias("t"), *HELD, at("ts"))
    both = c.withWatermark("_at", delay).union(r.withWatermark("_at", delay))
    processor = Matcher(settings.match_window_minutes * 60, settings.candidate_ceiling, keep)
    out = both.groupBy("store_key").transformWithStateInPandas(processor, OUT, "append", "EventTime")
    score = lambda p: attribution.scored({"candidates": F.col("candidates"), "call_ts": F.col("call_ts"), "caller_state": F.col("caller_state"), "ts": p["ts"], "region": p["region"]}, settings)
    ranked = F.transform("pairs", lambda p: F.struct(score(p).alias("score"), *[p[n].alias(n) for n in ("ts", "imp_seq", "ip", "rida", "hh_id", "region", "city", "postal", "lmt")]))
    best = F.array_max(ranked)
    out = out.withColumn("_best", best).withColumn("best", F.when(F.col("_best").isNotNull(), F.struct(*[F.col(f"_best.{n}").alias(n) for n in attribution.BEST])))
    return attribution.decided(out.drop("pairs", "_best"), settings)
