"""Quality rules as a short-circuit cascade. DataFrame functions only.

Method: on a sample each rule's cost (seconds a row) and selectivity (share of rows it rejects) are measured;
rules run in the order of rejections per cost, and a row stops at the first rule that rejects it. The verdict
is that of all rules, so it does not depend on the sample; only the time does. The sample is at most
``SAMPLE_ROWS`` rows of at most ``SAMPLE_CHARS`` characters and orders rules, nothing else. The base figures are
results of their own, so they are found for every row, before the cascade.

Base figures are exact for whole texts: words are runs without ASCII white space; repeated windows are found
by sorting the 64-bit hashes of a text's three-word windows, only for texts that have equal ones.

Very long texts are judged whole. Columns other than those asked for are not looked at.

Defined results: a null text has no words, all figures 0, ``base_failed`` true and ``kept`` false; so has an
empty one. Repeated rows are judged separately. An empty table gives an empty table.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.common import WORD, texts

SAMPLE_ROWS, SAMPLE_CHARS = 500, 20_000
#: How often the sample is read to measure a rule.
TIMES = 20
MIN_WORDS = 50
WINDOW = 3


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a Boolean column over ``text`` and the base figures; never null."""

    name: str
    rejects: Callable[[], Column]


def without(pattern: str) -> Column:
    """How many characters of the text remain without what matches."""
    return F.length(F.regexp_replace("text", pattern, ""))


#: Shares above which a text is rejected.
RULES = (
    Rule("symbols", lambda: F.col("n_symbols") * 10 > F.col("n_words")),
    Rule("capitals", lambda: (F.col("n_words") > 0) & (without("[^A-Z]+") * 10 > F.col("word_chars") * 4)),
    Rule("shouting", lambda: without("[^!?]+") * 10 > F.col("n_words") * 3),
    Rule("digits", lambda: without("[^0-9]+") * 10 > F.col("word_chars") * 5),
    Rule("same_lines", lambda: F.col("n_dup_lines") * 10 > F.size(F.split("text", "\n")) * 5),
    Rule("word_length", lambda: ~F.col("word_chars").between(2 * F.col("n_words"), 15 * F.col("n_words"))),
)


def figures(docs: DataFrame, *more: str) -> DataFrame:
    """``texts`` of ``docs`` with the base figures. Each step is its own projection, so arrays are made once."""
    d = texts(docs, *more).withColumn("_w", F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)))
    d = d.withColumn("_l", F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)))
    d = d.withColumn("n_words", F.size("_w").cast("long"))
    d = d.withColumn("word_chars", F.length(F.array_join("_w", "")).cast("long"))
    d = d.withColumn("n_symbols", without("[^#*$%&|<>]+").cast("long"))
    d = d.withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long")).drop("_l")
    none = F.array().cast("array<bigint>")
    at = F.sequence(F.lit(0), F.greatest(F.size("_w") - WINDOW, F.lit(0)))
    windows = F.transform(at, lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(WINDOW)]))
    d = d.withColumn("_h", F.when(F.col("n_words") > WINDOW, windows).otherwise(none)).drop("_w")
    d = d.withColumn("_n", F.size("_h")).withColumn("_again", F.size(F.array_distinct("_h")) < F.col("_n"))
    pairs = F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("_s", F.when(F.col("_again"), pairs).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))).drop("_h")
    same = lambda e, j: F.coalesce(F.get("_s", j)["h"] == e["h"], F.lit(False))
    again = F.filter("_s", lambda e, j: same(e, j - 1) | same(e, j + 1))
    d = d.withColumn("_p", F.sort_array(F.transform(again, lambda e: e["i"]))).drop("_s")
    steps = F.transform("_p", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(p - F.get("_p", j - 1), F.lit(WINDOW))))
    d = d.withColumn("n_repeat_words", F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x))
    return d.drop("_p", "_n", "_again")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def costs(sample: DataFrame, rules: tuple[Rule, ...] = RULES, times: int = TIMES) -> dict[str, float]:
    """Seconds that each rule takes for a row of ``sample``, which is read ``times`` over so that a job's own time,
    measured without any rule and taken off, weighs little."""
    many = sample.select("*", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("_time"))

    def seconds(*what: Column) -> float:
        began = time.perf_counter()
        many.agg(F.count("*"), F.max("_time"), *what).collect()
        return time.perf_counter() - began

    n, _ = sample.count(), seconds()
    alone = min(seconds() for _ in range(2))
    return {r.name: max(min(seconds(F.count_if(r.rejects())) for _ in range(2)) - alone, 1e-6) / max(n * times, 1) for r in rules}


def ordered(sample: DataFrame, rules: tuple[Rule, ...] = RULES) -> list[Rule]:
    """Rules by rejections per cost on ``sample``, which has the base figures; ties stay in order."""
    sample = sample.cache()
    try:
        row = sample.agg(F.count("*").alias("_all"), *[F.sum(r.rejects().cast("int")).alias(r.name) for r in rules]).first()
        if not row["_all"]:
            return list(rules)
        cost = costs(sample, rules)
        return sorted(rules, key=lambda r: -row[r.name] / row["_all"] / cost[r.name])
    finally:
        sample.unpersist()


def sampled(docs: DataFrame) -> DataFrame:
    """At most ``SAMPLE_ROWS`` texts of at most ``SAMPLE_CHARS`` characters, from as few partitions as hold so many."""
    rows = texts(docs).where(F.length("text") <= SAMPLE_CHARS)
    return docs.sparkSession.createDataFrame(rows.limit(SAMPLE_ROWS).collect(), rows.schema)


def judged(docs: DataFrame, *more: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Base figures, ``base_failed``, ``rejected_by`` (the first rule of the cascade that rejects, null if none; which
    one of several depends on the sample) and ``kept`` (does not)."""
    first = F.when(base_failed(), F.lit("base"))
    for r in ordered(figures(sampled(docs)), rules):
        first = first.when(r.rejects(), F.lit(r.name))
    d = figures(docs, *more).withColumn("base_failed", base_failed()).withColumn("rejected_by", first)
    return d.withColumn("kept", F.col("rejected_by").isNull())


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
p AS (SELECT k, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
g AS (SELECT k, i, word, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c FROM p WINDOW o AS (PARTITION BY k ORDER BY i)),
r AS (SELECT k, i, count(*) OVER (PARTITION BY k, word, b, c) AS times FROM g WHERE c IS NOT NULL),
q AS (SELECT k, count(DISTINCT j) AS n_repeat_words FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM r WHERE times > 1) GROUP BY k),
l AS (SELECT k, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k),
f AS (
  SELECT w.k, doc_id, text, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN q ON w.k = q.k LEFT JOIN l ON w.k = l.k),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols * 10 > n_words
            OR n_words > 0 AND length(regexp_replace(text, '[^A-Z]', '', 'g')) * 10 > word_chars * 4
            OR length(regexp_replace(text, '[^!?]', '', 'g')) * 10 > n_words * 3
            OR length(regexp_replace(text, '[^0-9]', '', 'g')) * 10 > word_chars * 5
            OR n_dup_lines * 10 > len(string_split(text, chr(10))) * 5
            OR word_chars NOT BETWEEN 2 * n_words AND 15 * n_words) AS kept
FROM b
"""
