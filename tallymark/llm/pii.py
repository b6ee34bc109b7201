"""Personal data by weak supervision: labelers vote, expectation-maximisation weighs them, a classifier decides.

Method: candidates are the spans of the base patterns and of wider ones (spelled-out addresses, phone numbers
without a country code, long IP addresses, account and identity numbers, titled names). Three labelers vote
on each: the pattern's own checks (regex), lists of known parts (gazetteer), and the words before it (context);
each may abstain. Votes are counted over all documents by kind, expectation-maximisation estimates how
reliable each labeler is and how likely each pattern of votes is personal data, and a logistic span classifier is
trained on those likelihoods. It decides on the candidates that are not base spans; base spans always stay.

Vote patterns are at most 27 for each kind, so what the driver gathers is bounded. The classifier is trained on
at most ``TRAIN_ROWS`` candidates, those of the lowest hashes.

Defined results: null and empty texts have no spans. Repeated rows are searched separately. Whole texts are
searched, whatever their length; positions are code points, ends exclusive. Kinds added to the four base ones: account,
identity, name. Spans of equal start stay in order of kind and end; added spans may overlap one another, never a base
span. Columns beside ``doc_id`` and ``text`` are not looked at, and ``redacted`` keeps them. An empty table gives an
empty table, a table without candidates no classifier.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.llm.common import texts, tune, written

KINDS = ("email", "ip", "card", "phone", "account", "identity", "name")
BASE_KINDS = 4
TRAIN_ROWS = 20_000
ACCEPT = 0.5
CANDIDATE = "array<struct<start:int,end:int,kind:tinyint,base:boolean,votes:smallint,shape:array<float>>>"

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: As a match never starts inside a run of digits, the look-behind changes nothing but the time on long runs.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

#: Wider patterns, by number of the kind.
WIDER = (
    (0, re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]+(?: ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]+)+")),
    (1, re.compile(r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b")),
    (3, re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")),
    (4, re.compile(r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b")),
    (5, re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    (6, re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z][a-z]+(?: [A-Z][a-z]+)?")),
)
#: Words before a span that speak for a kind, known top-level names and first digits of cards.
CONTEXT = {
    0: "mail email e-mail contact write address correo courriel",
    1: "ip host server address from client adresse",
    2: "card visa mastercard amex credit payment tarjeta carte karte",
    3: "phone call tel telephone mobile fax number contact ring telefon",
    4: "iban account bank konto compte cuenta",
    5: "ssn social security id identity number",
    6: "by dear from contact name",
}
CONTEXT_WORDS = {k: frozenset(v.split()) for k, v in CONTEXT.items()}
TOP_NAMES = frozenset("com org net edu gov io de fr es uk eu info biz co us ca".split())
CARD_STARTS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "2")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the email pattern: from each ``@`` back over the local part and on over the domain."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            done = m.end()
            out.append((start, done))
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base patterns, in order."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x[-6:]) <= 255 and len(x.lstrip("0")) < 4 for x in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return sorted(out)


def mod97(account: str) -> bool:
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def votes(text: str, start: int, kind: int, end: int) -> tuple[int, int, int]:
    """Regex, gazetteer and context: 1 for, 0 against, 2 abstains."""
    span = text[start:end]
    d = digits_of(span)
    regex = gazetteer = 2
    if kind == 0:
        regex = int(".." not in span and span[0] not in ".%-")
        tail = re.split(r"[^A-Za-z0-9-]+", span)[-1]
        gazetteer = int(tail.lower() in TOP_NAMES)
    elif kind == 1:
        regex = int(":" in span or not any(len(x) > 1 and x[0] == "0" for x in span.split(".")))
        gazetteer = 0 if span.startswith(("0.", "255.255.255")) else 2
    elif kind == 2:
        regex = int(len(set(d)) > 2)
        gazetteer = int(d.startswith(CARD_STARTS))
    elif kind == 3:
        regex = int(10 <= len(d) <= 15)
        area = d[-10:-7]
        gazetteer = int(area[:1] not in ("0", "")) if not d.startswith("1") or len(d) == 11 else 2
    elif kind == 4:
        regex = int(mod97(span))
    elif kind == 5:
        regex = int(span[:3] not in ("000", "666") and span[0] != "9" and span[4:6] != "00")
    else:
        regex, gazetteer = 2, int(span.split()[0].rstrip(".") in ("Dr", "Prof", "Mr", "Mrs", "Ms"))
    before = re.findall(r"[\w-]+", text[max(0, start - 40) : start].lower())[-4:]
    context = 1 if CONTEXT_WORDS[kind] & set(before) else 2
    if context == 2 and before and before[-1] in ("version", "figure", "page", "line", "order", "isbn", "serial"):
        context = 0
    return regex, gazetteer, context


def shape(text: str, start: int, end: int) -> list[float]:
    """What the span classifier sees of a span besides its kind and votes."""
    span = text[start:end]
    n = len(span)
    share = lambda has: sum(map(has, span)) / n
    edges = float(start == 0 or text[start - 1].isspace()) + float(end == len(text) or not text[end].isalnum())
    return [min(n, 40) / 40, share(str.isdigit), share(str.isupper), share(str.islower), share(lambda c: c in " .-()"), edges / 2]


def candidates(text: str) -> list[tuple]:
    """All candidate spans, in order of start, end and kind, with votes and shape."""
    base = base_spans(text)
    spans = [(a, k, b, True) for a, k, b in base]
    some = DIGIT.search(text) is not None
    for kind, pattern in WIDER:
        if not (some if kind in (3, 4, 5) else "dot" in text if kind == 0 else ":" in text if kind == 1 else True):
            continue
        for m in pattern.finditer(text):
            if not any(a < m.end() and m.start() < b for a, _, b in base):
                spans.append((m.start(), kind, m.end(), False))
    out = []
    for a, k, b, is_base in sorted(spans):
        r, g, c = votes(text, a, k, b)
        out.append((a, b, k, is_base, r * 9 + g * 3 + c, shape(text, a, b)))
    return out


def found(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the ``candidates`` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int8()), ("base", pa.bool_()), ("votes", pa.int16()), ("shape", pa.list_(pa.float32()))])
        names = ("start", "end", "kind", "base", "votes", "shape")
        for batch in batches:
            rows = [[dict(zip(names, c, strict=True)) for c in candidates(t or "")] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(item))], ["doc_id", "candidates"])

    tune(docs.sparkSession)
    return texts(docs).mapInArrow(run, f"doc_id long, candidates {CANDIDATE}")


def reliabilities(counts: dict[tuple[int, int], int], rounds: int = 50) -> tuple[dict[tuple[int, int], float], dict[int, np.ndarray]]:
    """Expectation-maximisation over vote patterns: how likely each (kind, votes) is personal data, and for each
    kind how often each labeler is right about true and about false spans."""
    likely, rates = {}, {}
    for kind in sorted({k for k, _ in counts}):
        patterns = [v for k, v in counts if k == kind]
        n = np.array([counts[kind, v] for v in patterns], float)
        vote = np.array([(v // 9, v // 3 % 3, v % 3) for v in patterns])
        spoke, yes = vote < 2, vote == 1
        p = np.where(spoke.any(1), (yes.sum(1) + 0.5) / (spoke.sum(1) + 1), 0.5)
        # A labeler that always says the same of a kind cannot tell its spans apart; it counts at the start only.
        varies = (spoke & yes).any(0) & (spoke & ~yes).any(0)
        spoke, rate = spoke & varies, np.full((2, 3), 0.5)
        for _ in range(rounds if varies.any() else 0):
            prior = (p @ n + 1) / (n.sum() + 2)
            right = np.array([[(w * n) @ (yes & spoke) + a, (w * n) @ (~yes & spoke) + b] for w, a, b in ((p, 4, 1), (1 - p, 1, 4))], float)
            rate = right[:, 0] / right.sum(1)  # of true, of false spans: how often a labeler says yes
            log = [np.log(q) + (spoke * (yes * np.log(r) + ~yes * np.log(1 - r))).sum(1) for q, r in ((prior, rate[0]), (1 - prior, rate[1]))]
            p = 1 / (1 + np.exp(np.clip(log[1] - log[0], -30, 30)))
        likely |= {(kind, v): float(x) for v, x in zip(patterns, p, strict=True)}
        rates[kind] = rate
    return likely, rates


def features(kind: int, vote: int, form: list[float]) -> np.ndarray:
    x = np.zeros(len(KINDS) + 9 + len(form) + 1)
    x[kind] = 1
    for i, v in enumerate((vote // 9, vote // 3 % 3, vote % 3)):
        x[len(KINDS) + 3 * i + v] = 1
    x[-1 - len(form) : -1] = form
    x[-1] = 1
    return x


def fit(rows: list[tuple[int, int, list[float]]], likely: dict[tuple[int, int], float], rounds: int = 30) -> np.ndarray:
    """Logistic span classifier on the likelihoods, by Newton steps."""
    x = np.array([features(*r) for r in rows])
    y = np.array([likely[k, v] for k, v, _ in rows])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (p - y) + 0.1 * w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def learned(rows: DataFrame, train_rows: int = TRAIN_ROWS) -> np.ndarray | None:
    """The classifier's weights from the candidates of all documents."""
    c = rows.select(F.inline("candidates"))
    counts = {(r["kind"], r["votes"]): r["count"] for r in c.groupBy("kind", "votes").count().collect()}
    if not counts:
        return None
    total = sum(counts.values())
    likely, _ = reliabilities(counts)
    key = F.xxhash64("start", "end", "kind", "votes", "shape")
    share = min(1.0, 2 * train_rows / total)
    few = c.where(F.pmod(key, F.lit(1_000_000)) < int(share * 1_000_000) + 1).orderBy(key).limit(train_rows)
    sample = [(r["kind"], r["votes"], list(r["shape"])) for r in few.select("kind", "votes", "shape").collect()]
    return fit(sample, likely) if sample else None


def accepted(cands: list[dict], weights: np.ndarray | None) -> list[tuple[int, int, int, bool]]:
    """Base spans and the others that the classifier takes, as ``(start, kind, end, base)`` in order."""
    out = [(c["start"], c["kind"], c["end"], c["base"]) for c in cands if c["base"] or (weights is not None and features(c["kind"], c["votes"], c["shape"]) @ weights >= np.log(ACCEPT / (1 - ACCEPT)))]
    return sorted(out)


def detected(docs: DataFrame) -> DataFrame:
    """``doc_id``, counts of the base kinds, ``base_sha256``, ``spans`` and ``n_added``."""
    rows = written(found(docs), "pii")
    weights = learned(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for cands in batch.column("candidates").to_pylist():
                spans = accepted(cands, weights)
                said = [f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in spans]
                base = ",".join(s for s, x in zip(said, spans, strict=True) if x[3])
                n = [sum(x[3] and x[1] == k for x in spans) for k in range(BASE_KINDS)]
                out.append((*n, hashlib.sha256(base.encode()).hexdigest(), ",".join(said), sum(not x[3] for x in spans)))
            cols = list(zip(*out, strict=True)) or [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
            names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], names)

    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def most_of(kind: pa.DataType) -> float | None:
    """The largest count that a column of this type holds; none if it is no number."""
    if pa.types.is_integer(kind):
        return (1 << (kind.bit_width - 1)) - 1
    if pa.types.is_decimal(kind):
        return 10 ** (kind.precision - kind.scale) - 1
    return float("inf") if pa.types.is_floating(kind) else None


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with each span replaced by ``[kind]``, and ``n_chars`` set to the new length where that column exists and is a
    number (null where its type is too small for it)."""
    weights = learned(written(found(docs), "pii"))
    names, schema = docs.columns, T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ("start", "end", "kind", "base", "votes", "shape")
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                parts, at = [], 0
                for a, k, b, _ in accepted([dict(zip(keys, c, strict=True)) for c in candidates(text or "")], weights):
                    if a >= at:
                        parts += [text[at:a], f"[{KINDS[k]}]"]
                    at = max(at, b)
                out.append(text if not parts else "".join(parts) + text[at:])
            cols = {"text": pa.array(out, pa.string())}
            if "n_chars" in names:
                said, kind = batch.column("n_chars"), batch.schema.field("n_chars").type
                most = most_of(kind)
                if most is not None:
                    n = [x.as_py() if t is None else len(t) if len(t) <= most else None for t, x in zip(out, said, strict=True)]
                    cols["n_chars"] = pa.array(n, kind)
            yield pa.RecordBatch.from_arrays([cols.get(n, batch.column(n)) for n in names], names)

    tune(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detected(spark.read.parquet(f"{sf_dir}/documents.parquet"))
