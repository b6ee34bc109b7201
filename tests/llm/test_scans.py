import hashlib
import itertools
import math
import random
import re

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallymark.llm import fingerprint, pii, quality, secretscan
from tests.llm.conftest import AWKWARD, DOCS

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def plain_pii(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 10 <= len(digits(m)) <= 15]
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", ".", "@", "b-c", "%", " ", "1", "255", "256", "0", "4", "4111111111111111", "+", "(", ")", "-", "é", "x@y.zz", "1.2.3.4", "+1 (415) 555-0142", "00000001"]), max_size=25).map("".join))
def test_base_personal_data_equals_plain_patterns(text):
    assert pii.base_spans(text) == plain_pii(text)


def test_personal_data_query_and_redaction(spark, clashing):
    rows = [(1, "call 415-555-0142 or jo (at) host (dot) com or jo@host.com, card 4111 1111 1111 1111"), (2, None), (3, ""), (3, "at 10.0.0.1 é +1 (415) 555-0142"), (None, "9" * 60_000)]
    rows += [(10 + i, f"phone 212-555-{1000 + i} and mail a{i}@b.com") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = pii.detected(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    one = by[1][0]
    assert (one.n_email, one.n_ip, one.n_card, one.n_phone) == (1, 0, 1, 0)
    base = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in plain_pii(rows[0][1]))
    assert one.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert set(base.split(",")) <= set(one.spans.split(",")) and one.n_added >= 1
    assert by[2][0].spans == "" and by[None][0].n_card == 0
    clean = {r.doc_id: r.text for r in pii.redacted(docs).collect() if r.doc_id != 3}
    assert "[email]" in clean[1] and "4111" not in clean[1] and clean[2] is None
    for kind in ("int", "short", "double", "decimal(20,0)", "string"):
        other = docs.withColumn("n_chars", F.lit(7).cast(kind))
        assert pii.redacted(other).dtypes == other.dtypes
        assert {str(r.n_chars) for r in pii.redacted(other).where("text is null").collect()} <= {str(r.n_chars) for r in other.collect()}
        if kind != "string":
            rows = pii.redacted(other).where("text is not null").collect()
            assert [r.n_chars for r in rows] == [None if kind == "short" and len(r.text) > 32_767 else len(r.text) for r in rows]
    assert pii.redacted(clashing).columns == clashing.columns and pii.redacted(clashing).count() == len(AWKWARD)


def test_vote_aggregation_finds_the_reliable_labelers():
    import numpy as np

    r = np.random.default_rng(0)
    counts = {}
    for _ in range(20_000):
        true = r.random() < 0.4
        v = [int(true) if r.random() < p else int(not true) for p in (0.95, 0.9, 0.6)]
        counts[0, v[0] * 9 + v[1] * 3 + v[2]] = counts.get((0, v[0] * 9 + v[1] * 3 + v[2]), 0) + 1
    likely, rates = pii.reliabilities(counts)
    assert likely[0, 13] > 0.95 and likely[0, 0] < 0.05
    assert rates[0][0][0] == pytest.approx(0.95, abs=0.04) and rates[0][0][2] == pytest.approx(0.6, abs=0.05)


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_secrets(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "Secret", "api_key", "APIKEY", "passwd", "=", ":", " ", '"', "abc123", "x" * 12, "AKIA", "ABCD1234EFGH56", "0f" * 8, "deadbeef", "é", "\n", "ſecret", "pwd: Zk3$x9!qLm"]), max_size=14).map("".join))
def test_base_secrets_equal_plain_patterns(text):
    spans, n = secretscan.found(text)
    assert [s for s in spans if s[1] < 3] == plain_secrets(text) and n == len(plain_secrets(text))


def exhaustive(value, rank):
    """The least cost by trying every way to cut ``value``."""
    low, one = value.lower(), secretscan.brute(value)

    def span(a, b):
        part, costs = low[a:b], [secretscan.word_cost(value[a:b], rank) if 3 <= b - a <= secretscan.LONGEST else math.inf]
        if b - a >= 3 and len(set(part)) == 1:
            costs.append(secretscan.REPEAT + math.log10(b - a))
        if b - a >= 3 and all(p in secretscan.NEXT for p in zip(part, part[1:])):
            costs.append(secretscan.WALK + math.log10(b - a))
        costs += [cost for form, cost in secretscan.DATES if form.fullmatch(part)]
        return min(costs) + (secretscan.JOIN if a else 0.0)

    best = math.inf
    for cuts in itertools.product([0, 1], repeat=len(value) - 1):
        edges = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(value)]
        best = min(best, sum(min(span(a, b), one * (b - a)) for a, b in zip(edges, edges[1:])))
    return best


def test_guess_cost_is_the_least_of_all_segmentations():
    r = random.Random(7)
    rank = secretscan.ranks([*secretscan.WORDS, "sum", "summers", "ta"])
    bits = ["2024", "3212", "01", "12", "31", "aaa", "qwer", "sum", "mer", "s", "P4ss", "x", "#", "1999", "-", "765", "the"]
    values = ["3212024x", "#3212024x", "20240131", "31012024", "01312024", "aaaaqwe", "summers1"]
    values += ["".join(r.choice(bits) for _ in range(4))[:11] for _ in range(300)]
    for v in values:
        assert secretscan.guess_cost(v, rank) == pytest.approx(exhaustive(v, rank)), v


def by_every_end(value, rank):
    """The least cost from every place over every end, runs and words alike."""
    low, one, n = value.lower(), secretscan.brute(value), len(value)
    least = [0.0] + [math.inf] * n
    for i in range(n):
        base = least[i] + (secretscan.JOIN if i else 0.0)
        least[i + 1] = min(least[i + 1], least[i] + one)
        same = walk = True
        for end in range(i + 1, n + 1):
            part = low[i:end]
            same, walk = same and part[-1] == part[0], walk and (end == i + 1 or (low[end - 2], low[end - 1]) in secretscan.NEXT)
            if end - i >= 3:
                costs = [secretscan.REPEAT + math.log10(end - i)] * same + [secretscan.WALK + math.log10(end - i)] * walk
                costs += [secretscan.word_cost(value[i:end], rank)] if end - i <= secretscan.LONGEST else []
                costs += [c for form, c in secretscan.DATES if form.fullmatch(part)]
                least[end] = min([least[end], *(base + c for c in costs)])
    return least[n]


def test_runs_from_their_starts_alone_cost_as_much_as_from_every_place():
    r = random.Random(5)
    rank = secretscan.ranks([*secretscan.WORDS, "zzzz", "pass", "zz9", "aaaaaa", "qwert", "asdfghjkl"])
    bits = ["z" * 40, "z" * 3, "zz9", "aaa", "qwertyuiop", "asdfghjkl", "1" * 25, "123456", "1234321", "pass", "word", "x", "Z", "2024", "9", "#" * 30]
    for _ in range(150):
        v = "".join(r.choice(bits) for _ in range(r.randrange(1, 7)))
        assert secretscan.guess_cost(v, rank) == pytest.approx(by_every_end(v, rank)), v


def test_a_very_long_value_is_segmented_whole():
    import time

    assert secretscan.guess_cost("a" * 20_000) < 7 and secretscan.guess_cost("12" * 5_000) < 7
    began = time.process_time()
    for value in ("z" * 160_000, "qwertyuiop" + "z" * 100_000 + "1212" * 15_000):
        assert len(secretscan.found("pwd: " + value)[0]) <= 2
    assert time.process_time() - began < 30  # with every start in a run, two minutes and more


def test_words_of_the_documents_are_cheap(spark, empty):
    words = ["extraordinary", "circumstance", "wonderland"]
    docs = spark.createDataFrame([(i, f"The {words[i % 3]}, {words[0]}! passphrase: {words[1]} passphrase: zqxkvjwpylmdx", "en", "a", 0) for i in range(9)] + [(20, "passphrase: zqxkvjwpylmd Uncommon7 12x", "en", "a", 0), (21, None, "en", "a", 0)], DOCS)
    assert secretscan.frequent_words(docs) == ["passphrase", "extraordinary", "the", "circumstance", "wonderland"]
    assert secretscan.frequent_words(docs, 3) == ["passphrase", "extraordinary", "the"] and secretscan.frequent_words(docs, 4) == ["passphrase", "extraordinary", "the"]
    got = {r.doc_id: r.n_guess for r in secretscan.scanned(docs).collect()}
    assert got.pop(20) == 1 and got.pop(21) == 0 and set(got.values()) == {1}  # the repeated secret, not the repeated word
    assert secretscan.frequent_words(empty) == [] and secretscan.scanned(empty).count() == 0


def test_planted_secrets_are_found_and_prose_is_left_alone():
    r = random.Random(3)
    chars = "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789!#%&*+"
    names = ["password", "pwd", "passphrase", "dbPassword", "API key", "secret-key", "login", "pin", "Bearer"]
    found = sum(any(k == 3 or k == 0 for _, k, _ in secretscan.found(f"some text {r.choice(names)}{r.choice([': ', '=', ' = ', ':'])}{''.join(r.choice(chars) for _ in range(r.randrange(8, 16)))} and more")[0]) for _ in range(400))
    assert found >= 0.95 * 400
    prose = ["the password is wonderful", "login: monday, then token: september", "pass: 12345678", "pin: 19991231", "secret = qwertyuiop", "auth: aaaaaaaaaa", "password: letmein123"]
    assert [secretscan.found(t)[0] for t in prose] == [[]] * len(prose)


def test_guess_costs_and_contexts(spark, clashing):
    cost = secretscan.guess_cost
    assert cost("password") < 2 and cost("qwertyuiop") < 4 and cost("aaaaaaaaaaaa") < 4 and cost("1999-12-31") < 6
    assert cost("P@ssw0rd2024") < 7 < 14 < cost("x7#Kq!2vLp9z")
    text = 'pwd: x7#Kq!2vLp9z and pass = password1 and the passphrase is wonderful, token = "0123456789abcdef0123"'
    spans, _ = secretscan.found(text)
    assert [text[a:b] for a, k, b in spans if k == 3] == ["x7#Kq!2vLp9z"]
    assert [k for _, k, _ in spans] == [3, 0, 2]
    got = secretscan.scanned(clashing).collect()
    assert len(got) == len(AWKWARD) and all(r.spans == "" for r in got)


def test_cost_decides_on_letters_and_camel_case_names():
    guessed = lambda t: [t[a:b] for a, k, b in secretscan.found(t)[0] if k == 3]
    assert guessed("passphrase: zqxkvjwpylmd, pwd = Xqzkvjtrwnbd") == ["zqxkvjwpylmd", "Xqzkvjtrwnbd"]
    assert guessed("dbPassword=Tr0ub4dor&3xyz and userPIN: zqxkvjwpylmd; DBPwd=zqxkvjwpylmd") == ["Tr0ub4dor&3xyz", "zqxkvjwpylmd", "zqxkvjwpylmd"]
    assert guessed("pwd: sunshine, pass=letmeinwelcome") == []
    assert guessed("the passphrase is extraordinarily long; compass: zqxkvjwpylmd; spin: zqxkvjwpylmd") == []


def plain_quality(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    again = {i + k for i, x in enumerate(g) if g.count(x) > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again)


@pytest.mark.parametrize("wide", [False, True])
def test_quality_figures_equal_plain_ones(spark, clashing, wide):
    rows = [r[:2] for r in AWKWARD if r[0] != 4]
    rows += [(20, "a b c a b c d a b c"), (21, "x x x x x x"), (22, "é|é <a>\nsame\nsame\n \n \n same"), (23, "one two"), (24, "one two three"), (25, "a b c d " * 40), (26, " ".join(f"w{i} and" for i in range(90)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    if wide:
        docs = docs.withColumns({n: F.lit(1) for n in ("n_words", "_w", "_h", "kept", "word_chars")})
    got = quality.judged(docs).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got], key=key) == sorted([(d, *plain_quality(t)) for d, t in rows], key=key)
    kept = {r.doc_id: (r.base_failed, r.kept) for r in got}
    assert kept[25] == (True, False) and kept[26] == (False, True) and kept[20] == (True, False)


def test_cascade_puts_cheap_rejecting_rules_first(spark, empty):
    rules = tuple(quality.Rule(n, f) for n, f in (("never", lambda: F.col("n_words") < 0), ("often", lambda: F.col("n_words") > 1)))
    docs = spark.createDataFrame([(i, "a b c") for i in range(50)], "doc_id long, text string")
    assert [r.name for r in quality.ordered(quality.figures(docs), rules)] == ["often", "never"]
    assert quality.judged(empty).count() == 0


def paragraphs(t):
    out = []
    for line in t.split("\n"):
        for piece in re.split(r"(?<=[.!?]) ", line) if len(line) > 240 else [line]:
            if len(piece) > 240:
                cut = lambda w: xxhash.xxh64(w.encode(), seed=42).intdigest()
                signed = lambda n: n - (1 << 64) if n >> 63 else n
                out += " ".join(w + "\n" if signed(cut(w)) % fingerprint.CUT == 0 else w for w in piece.split(" ")).replace("\n ", "\n").split("\n")
            else:
                out.append(piece)
    return {p for p in out if p.strip(" ")}


def jaccard(a, b):
    return 1.0 if not a | b else len(a & b) / len(a | b)


def test_fingerprints_equal_plain_comparison(spark):
    line = lambda i: f"line {i} says é{i * i}."
    rows = [(3 * i, "\n".join(line(j % 37 + i % 5) for j in range(i * 2))) for i in range(30)]
    rows += [(1000, None), (1001, ""), (1002, " ".join(line(i) for i in range(60))), (1003, "\n".join(line(i) for i in range(900))), (1004, "\n".join(line(i) for i in range(40, 900)))]
    got = {r.doc_id: r for r in fingerprint.compared(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert len(got) == len(rows)
    for (doc, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        text, after, r = text or "", after or "", got[doc]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(jaccard(paragraphs(text), paragraphs(edited)))
        assert r.near_next == pytest.approx(jaccard(paragraphs(text), paragraphs(after)))
    prints = {(t or ""): got[d].fingerprint for d, t in rows}
    assert len(set(prints.values())) == len(prints)


def test_stored_fingerprints_are_subtracted_without_their_texts(spark):
    line = lambda i: f"line {i} says {i * i}."
    texts = ["\n".join(line(j) for j in range(n)) for n in (0, 1, 5, 8, 9, 30, 33, 60, 64, 66)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string").withColumn("keys", F.expr(fingerprint.digests("text")))
    d = d.withColumn("p", F.expr(fingerprint.printed("text", "keys")))
    both = d.join(d.toDF("j", "text2", "keys2", "q"), F.abs(F.col("i") - F.col("j")) <= 1)
    got = both.select("i", "j", F.expr(fingerprint.likeness_of_prints("p", "q")).alias("near"), F.expr(fingerprint.recovered("keys", "keys2")).alias("d"), "keys", "keys2").collect()
    for r in got:
        a, b = paragraphs(texts[r.i]), paragraphs(texts[r.j])
        assert {(x.k, x.n) for x in r.d} == {(k, 1) for k in set(r["keys"]) - set(r.keys2)} | {(k, -1) for k in set(r.keys2) - set(r["keys"])}
        if abs(len(a) - len(b)) <= 4:
            assert r.near == pytest.approx(jaccard(a, b)), (r.i, r.j)
        assert r.near is None or r.near == pytest.approx(jaccard(a, b))


def test_planted_personal_data_beside_the_base_kinds_is_found(spark):
    """Spelled-out addresses, phones without a country code and identity numbers, among texts that only look so."""
    r = random.Random(4)
    kinds = [
        lambda: f"mail me: jo{r.randrange(99)} (at) host{r.randrange(99)} dot com",
        lambda: f"contact: ann.lee at mail{r.randrange(99)} dot org",
        lambda: f"call phone ({r.randrange(200, 999)}) 555-{r.randrange(1000, 9999)}",
        lambda: f"tel {r.randrange(200, 999)}-555-{r.randrange(1000, 9999)}",
        lambda: f"ssn {r.randrange(100, 600)}-{r.randrange(10, 99)}-{r.randrange(1000, 9999)}",
    ]
    rows = [(i, f"some words before {kinds[i % 5]()} and after.") for i in range(300)]
    clean = [lambda: f"we met at noon dot {r.randrange(99)}", lambda: f"version {r.randrange(100, 999)}.{r.randrange(100, 999)}.{r.randrange(1000, 9999)}", lambda: f"order 000-{r.randrange(10, 99)}-{r.randrange(1000, 9999)}", lambda: "plain words only"]
    rows += [(1000 + i, f"some words before {clean[i % 4]()} and after.") for i in range(300)]
    got = {x.doc_id: x.n_added for x in pii.detected(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] > 0 for i in range(300)) >= 0.9 * 300
    assert sum(got[1000 + i] > 0 for i in range(300)) <= 0.05 * 300


def test_an_edit_of_a_long_line_leaves_most_of_it_alike(spark):
    r = random.Random(1)
    row = (1, " ".join(f"word{r.randrange(10**5)}" for _ in range(2400)))
    got = fingerprint.compared(spark.createDataFrame([row, (2, "something else " * 100)], "doc_id long, text string")).where("doc_id = 1").first()
    assert got.near_edited > 0.4 and len(got.removed) > 5


def test_costly_rules_come_after_cheap_ones_that_reject_as_much(spark):
    docs = spark.createDataFrame([(i, "a b c " * 400) for i in range(60)], "doc_id long, text string")
    rules = tuple(quality.Rule(n, f) for n, f in (("costly", lambda: F.length(F.regexp_replace("text", "[a-c] (?=[a-c] [a-c] [a-c] z)|b", "")) > 1), ("cheap", lambda: F.col("n_words") > 1)))
    sample = quality.figures(docs).cache()
    cost = quality.costs(sample, rules)
    assert cost["costly"] > 2 * cost["cheap"]
    assert [r.name for r in quality.ordered(sample, rules)] == ["cheap", "costly"]


def test_fingerprints_defined_results(spark, clashing, empty):
    assert fingerprint.compared(empty).count() == 0
    got = fingerprint.compared(clashing).collect()
    assert len(got) == len(AWKWARD)
    assert len({r.fingerprint for r in got if r.doc_id in (1, 7)}) == 1
    one = fingerprint.compared(spark.createDataFrame([(1, "alone here", None, None, 3)], DOCS)).collect()[0]
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"alone heal").hexdigest()


def test_a_difference_of_sketches_is_one_sketch_and_is_not_carried_on_when_empty(spark):
    """Both lists are taken into the same cells, and cells that give up nothing more are dropped, not copied from round to round."""
    sql = fingerprint.differing("a", "b", 4, True)
    assert sql.count("sequence(0, 3)") == 3 and "slice(s.c, 1, 0)" in sql
    d = spark.createDataFrame([([1, 2, 3], [3, 4]), ([5], [5]), ([], [])], "a array<long>, b array<long>")
    got = [sorted((x.k, x.n) for x in r.d) for r in d.selectExpr(f"{sql} AS d").collect()]
    assert got == [[(1, 1), (2, 1), (4, -1)], [], []]
    many = spark.createDataFrame([(list(range(60)), [])], "a array<long>, b array<long>")
    assert many.selectExpr(f"{sql} AS d").first().d is None  # 12 cells do not give up 60
