"""Secret scans: fixed patterns, and guess costs of values in credential contexts.

Method: the values that stand behind a credential word (``pwd: ...``, ``passphrase = ...``) are segmented into
words, dates, repeats, keyboard walks and brute-force spans so that the product of guesses is least, by dynamic
programming over the value: every part of a repeat or walk and every form of date is tried. A value that costs at
least ``GUESSES`` (a power of ten) is a secret. Words cost their rank: first the common words of passwords, then the
``RANKED`` most frequent words of all documents that come up ``OFTEN`` other than behind a sign, so what people write is cheap and what is random is not. The
credential word may end a camel-case name (``dbPassword``). Not seen: values of fewer than six characters, and
letters alone, lower case from the second on, behind `` is ``, where prose stands.

The three base kinds (assign, access, hex) are found as their patterns say and always stay; values that lie in
a base span add nothing.

Defined results: null and empty texts have no spans. Repeated rows are scanned separately. Whole texts are
scanned; positions are code points. A value is segmented whole, whatever its length. Words of equal frequency rank in
their own order. Other columns than ``doc_id`` and ``text`` are not looked at. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.common import dropped, texts, tune, written

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A run of at least 16; a shorter run cannot hide a longer one.
HEX = re.compile(r"[0-9a-f]{16,}")
NAMES = "password|passwd|passphrase|passcode|pwd|pass|pin|secret|credentials?|auth|bearer|token|(?:api|access|private|secret)[_ -]?key|login"
#: A credential word by itself, behind a sign or digit, or as the end of a camel-case name.
CONTEXT = re.compile(
    rf"""(?:(?<![A-Za-z])(?i:{NAMES})|(?:(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z]))(?i:{NAMES}))["']?\x20*(?:[:=]+|(\x20(?i:is)))\x20*["']?([^\s"',;]{{6,}})""",
    re.ASCII,
)
GUESSES = 10.0

#: Common words of passwords, the most common first.
WORDS = (
    "password 123456 qwerty letmein welcome admin login master monkey dragon sunshine princess football iloveyou "
    "shadow baseball superman batman trustno1 secret hello freedom whatever starwars summer winter spring autumn "
    "test guest root user pass changeme default example sample token access system server service house love "
    "money happy coffee computer internet january february march april may june july august september october "
    "november december monday tuesday wednesday thursday friday saturday sunday the and for you with this that from"
).split()
#: Words of the documents that are ranked, and their lengths.
RANKED, SHORTEST, LONGEST = 20_000, 3, 16
#: How often a word must come up, other than behind a sign, to be one.
OFTEN = 3
#: Rows that a task holds before it adds up what it has counted.
HELD = 1_000_000
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
NEXT = {(a, b) for row in (*ROWS, "abcdefghijklmnopqrstuvwxyz", "0123456789") for x in (row, row[::-1]) for a, b in zip(x, x[1:])}
LEET = str.maketrans("@4310$57!", "aaeiossti")
_SEP, _DAY, _MONTH, _YEAR = "[-/.]?", "(?:0[1-9]|[12][0-9]|3[01])", "(?:0[1-9]|1[0-2])", "(?:19|20)[0-9]{2}"
#: Forms of dates and their costs; each matches one end at a place.
DATES = [(re.compile(_YEAR), 2.2), *((re.compile(_SEP.join(f)), 4.3) for f in ((_YEAR, _MONTH, _DAY), (_DAY, _MONTH, _YEAR), (_MONTH, _DAY, _YEAR)))]


def ranks(words: list[str]) -> dict[str, int]:
    """Each word's rank, from 1, the first place counting."""
    return {w: i + 1 for i, w in reversed(list(enumerate(words)))}


RANK = ranks(WORDS)


def frequent_words(docs: DataFrame, n: int = RANKED) -> list[str]:
    """At most ``n`` words of letters alone, the most frequent, counted over all documents; counts are added up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for batch in batches:
            words = pc.utf8_split_whitespace(pc.fill_null(batch.column("text"), "").cast(pa.large_string())).flatten().dictionary_encode()
            which = words.indices.to_numpy()
            sign = pc.match_substring_regex(words.dictionary, "[:=][\"']?\\z").to_numpy(zero_copy_only=False)
            prose = np.concatenate([[True], ~sign[which[:-1]]])[: len(which)]  # what stands behind a sign may be a secret
            count = pa.array(np.bincount(which[prose], minlength=len(words.dictionary)), pa.int64())
            word = pc.ascii_lower(pc.utf8_trim(words.dictionary, ".,;:!?()\"'"))
            ok = pc.match_substring_regex(word, f"\\A[a-z]{{{SHORTEST},{LONGEST}}}\\z")
            held.append(pa.table({"word": word.filter(ok), "n": count.filter(ok)}))
            if sum(len(t) for t in held) > HELD:
                held = [summed()]
        if held:
            for part in summed().cast(pa.schema([("word", pa.string()), ("n", pa.int64())])).to_batches(max_chunksize=10_000):
                yield part

    tune(docs.sparkSession)
    counts = texts(docs).select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = written(counts.where(F.col("n") >= OFTEN), "words")
    # Frequencies up to 64 stand alone, above that eight share a doubling; the most frequent that fit are taken, whole.
    level = F.when(F.col("n") < 64, F.col("n")).otherwise(F.lit(64) + F.floor(F.log2(F.col("n") / 64) * 8)).cast("int")
    total, least = 0, 1 << 30
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # a few hundred rows
        total += r["count"]
        if total > n:
            break
        least = r["level"]
    found = counts.where(level >= least).collect()  # at most ``n`` rows
    dropped(counts)
    return [r["word"] for r in sorted(found, key=lambda r: (-r["n"], r["word"]))]


def brute(value: str) -> float:
    """Powers of ten to guess one more character of ``value`` by trying all of its kinds of characters."""
    kinds = ((str.isdigit, 10), (str.islower, 26), (str.isupper, 26), (lambda c: not c.isalnum(), 33))
    size = sum(n for has, n in kinds if any(map(has, value)))
    return math.log10(max(size, 10))


def runs(value: str) -> tuple[list[int], list[int]]:
    """End of the run of equal characters, and of the keyboard walk, from each place."""
    n = len(value)
    same, walk = [n] * n, [n] * n
    for i in range(n - 2, -1, -1):
        same[i] = same[i + 1] if value[i] == value[i + 1] else i + 1
        walk[i] = walk[i + 1] if (value[i], value[i + 1]) in NEXT else i + 1
    return same, walk


#: Powers of ten that a repeat and a walk cost besides that of their length, and each further span.
REPEAT, WALK, JOIN = 1.5, 2.0, 0.3


def word_cost(part: str, rank: dict[str, int]) -> float:
    """The cost of ``part`` as a word, with digits and signs for letters at a surcharge; infinite if it is none."""
    low = part.lower()
    upper = 0.0 if part.islower() or not part.isalpha() else 0.5
    return min((math.log10(rank[text] + 1) + upper + more for text, more in ((low, 0.0), (low.translate(LEET), 0.5)) if text in rank), default=math.inf)


def guess_cost(value: str, rank: dict[str, int] = RANK) -> float:
    """Least power of ten of guesses over all segmentations of ``value``.

    A repeat or walk is tried from where its run starts and from where a word, date or the other kind ended inside it.
    From the other places of a run it cannot be the least: where the run itself or one more character led there, the
    span that starts earlier in the run costs less by itself. So long runs take time in proportion to their length.
    """
    low, n = value.lower(), len(value)
    one = brute(value)
    ends = runs(low)
    least = np.full(n + 1, math.inf)
    least[0] = 0.0
    by, log = np.zeros(n + 1, np.int8), np.log10(np.arange(1, n + 1))  # what led to a place: a run's kind, a character (3)
    for i in range(n):
        at = float(least[i])
        base = at + (JOIN if i else 0.0)
        if at + one < least[i + 1]:
            least[i + 1], by[i + 1] = at + one, 3
        for kind, (stops, cost) in enumerate(zip(ends, (REPEAT, WALK)), 1):
            stop = stops[i]
            if stop < i + 3 or (i and stops[i - 1] == stop and by[i] in (kind, 3)):
                continue
            tried = base + cost + log[2 : stop - i]
            better = tried < least[i + 3 : stop + 1]
            least[i + 3 : stop + 1][better] = tried[better]
            by[i + 3 : stop + 1][better] = kind
        for end in range(i + SHORTEST, min(n, i + LONGEST) + 1):
            if (cost := word_cost(value[i:end], rank)) < math.inf and base + cost < least[end]:
                least[end], by[end] = base + cost, 0
        for form, cost in DATES:
            if (m := form.match(low, i)) and base + cost < least[m.end()]:
                least[m.end()], by[m.end()] = base + cost, 0
    return float(least[n])


def found(text: str, guesses: float = GUESSES, rank: dict[str, int] = RANK) -> tuple[list[tuple[int, int, int]], int]:
    """Spans ``(start, number of the kind, end)`` in order, and how many of them are of a base kind."""
    base = []
    if ":" in text or "=" in text:
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    more = []
    if ":" in text or "=" in text or " is " in text:
        for m in CONTEXT.finditer(text):
            a, b = m.span(2)
            while b > a and text[b - 1] in ".!?)":
                b -= 1
            value = text[a:b]
            prose = m[1] and value.isalpha() and value[1:].islower()  # "the token is wonderful"
            if b - a >= 6 and not prose and not any(s <= a and b <= e for s, _, e in base) and guess_cost(value, rank) >= guesses:
                more.append((a, 3, b))
    return sorted(base + more), len(base)


def scanned(docs: DataFrame, guesses: float = GUESSES) -> DataFrame:
    """``doc_id``, counts of the base kinds, ``base_sha256``, ``spans`` and ``n_guess``."""
    rank = ranks([*WORDS, *frequent_words(docs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                spans, _ = found(text or "", guesses, rank)
                said = [f"{KINDS[k]}:{a}:{b}" for a, k, b in spans]
                base = ",".join(s for s, (_, k, _) in zip(said, spans, strict=True) if k < 3)
                n = [sum(k == j for _, k, _ in spans) for j in range(4)]
                rows.append((*n[:3], hashlib.sha256(base.encode()).hexdigest(), ",".join(said), n[3]))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess"])

    tune(docs.sparkSession)
    return texts(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
