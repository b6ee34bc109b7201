import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallymark.llm import suffix
from tallymark.llm.common import new_path
from tallymark.llm.suffix import BYTES, IN_WORDS, Family, Units, cleaned, data_of, long_matches, merged, runs, sliding_min, suffixes
from tests.llm.conftest import AWKWARD


def brute(rows, length=400):
    """Every passage of every text, counted as bytes."""
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for (doc, _), r in zip(rows, raw):
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((doc, len(r), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def brute_words(rows, length=51):
    """Words in passages of so many that another document has too."""
    said = [(t or "").split() for _, t in rows]
    who = defaultdict(set)
    for (doc, t), w in zip(rows, said):
        for i in range(len(w) - length + 1):
            who[tuple(w[i : i + length])].add(t if doc is None else doc)
    out = []
    for (doc, _), w in zip(rows, said):
        hit = np.zeros(len(w), bool)
        for i in range(len(w) - length + 1):
            if len(who[tuple(w[i : i + length])]) > 1:
                hit[i : i + length] = True
        out.append((doc, int(hit.sum())))
    return out


BYTE_COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple(-1 if x is None else x for x in r))


def corpus(seed=1):
    r = random.Random(seed)
    fresh = lambda n: "".join(r.choice("abcdefé \n") for _ in range(n))
    shared = [fresh(n) for n in (380, 399, 400, 401, 520, 900, 2000)]
    rows = [fresh(r.randrange(0, 1500)) + r.choice(shared) + fresh(r.randrange(0, 900)) for _ in range(60)]
    rows += [r.choice(rows) for _ in range(10)]
    for _ in range(40):  # copies with an edit
        t = r.choice(rows)
        i = r.randrange(len(t))
        rows.append(t[:i] + "#" + t[i + 1 :])
    rows += ["a" * 1000, "a" * 450 + "b" * 399, "ab" * 700, "xyz" * 5, "", None, shared[4] + fresh(30) + shared[4]]
    rows += [shared[5][i : i + 600] + fresh(50) for i in range(0, 300, 7)]
    return list(enumerate(rows))


@pytest.mark.parametrize("group", [20_000, 3])
def test_removed_bytes_equal_those_of_all_passages(spark, group):
    rows = corpus()
    got = cleaned(spark.createDataFrame(rows, "doc_id long, text string"), group=group).select(*BYTE_COLUMNS).collect()
    assert order(got) == order(brute(rows))


@pytest.mark.parametrize("group", [20_000, 2])
def test_passages_of_words_in_other_documents(spark, group):
    r = random.Random(6)
    fresh = lambda n: [r.choice(["a", "to", "be"]) + str(r.randrange(10**6)) for _ in range(n)]
    shared = [fresh(n) for n in (50, 51, 60, 200)]
    rows = [(i, " ".join([*fresh(r.randrange(80)), *r.choice(shared), *fresh(r.randrange(80))])) for i in range(50)]
    twice = fresh(70)
    rows += [(100, " ".join([*twice, "and", *twice])), (101, " ".join([*twice[5:], "x", *shared[3][:55], *twice[:20], *shared[3][10:90]])), (102, "same " * 200), (103, "lone " * 200), (104, "same " * 60)]
    rows += [(105, " ".join([*shared[2], *shared[2]])), (105, " ".join(shared[2])), (None, " ".join(shared[1])), (None, None), (106, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = cleaned(df, group=group).select("doc_id", "n_passage_words").collect()
    assert order(got) == order(brute_words(rows))


def test_texts_made_to_have_equal_polynomial_hashes_lose_nothing(spark):
    """Differences that are a multiple of two to the 64th at every odd base: a hash modulo that takes them for equal."""
    c = np.array([1])
    for step in (32,) * 7 + (16, 8, 4):
        factor = np.zeros(step + 1, int)
        factor[0], factor[-1] = -1, 1
        c = np.convolve(c, factor)
    common = bytes(40 + i * i % 50 for i in range(400 - len(c)))
    rows = [(i, (common + bytes((80 + np.maximum(s * c, 0)).astype(np.uint8))).decode()) for i, s in ((1, 1), (2, -1))]
    assert all(len(t) == 400 for _, t in rows) and sum(x != y for x, y in zip(rows[0][1], rows[1][1])) == 64
    got = cleaned(spark.createDataFrame(rows, "doc_id long, text string")).select(*BYTE_COLUMNS).collect()
    assert order(got) == order(brute(rows)) and all(r.n_removed == 0 for r in got)


def test_batches_added_one_by_one_to_a_family_that_is_opened_again(spark):
    rows, folder = corpus(4), new_path(spark, "family")
    parts = [rows[i::5] for i in range(5)]
    hits = None
    for i, part in enumerate(parts):
        found = Family(spark, folder).add(suffixes(spark.createDataFrame(part, "doc_id long, text string")))
        hits = found if hits is None else hits.union(found)
        assert sorted(b for b, _ in Family(spark, folder).levels()) == [[0], [0, 0], [0, 1], [0, 0, 1], [0, 2]][i]  # the next batch merges equals
        so_far = [x for p in parts[: i + 1] for x in p]
        df = spark.createDataFrame(so_far, "doc_id long, text string")
        by = defaultdict(list)
        for m in long_matches(df, hits).collect():
            by[m.doc_id].append({"start": m.start, "end": m.end})
        assert {d: sum(b - a for a, b in merged(v)) for d, v in by.items()} == {d: n for d, _, n, _, _ in brute(so_far) if n}
    family = Family(spark, folder)
    (size, name), *_ = sorted(family.levels(), reverse=True)
    parts = [[r.seed for r in p.collect()] for p in [family.read(name)]]
    assert size == 2 and len(set(parts[0])) > 1 and len(family.states()) == 1
    family.delete()
    assert family.levels() == []


def test_a_batch_that_fails_leaves_the_family_as_it_was(spark, monkeypatch):
    family = Family(spark, new_path(spark, "family"))
    one = suffixes(spark.createDataFrame([(1, "x" * 500)], "doc_id long, text string"))
    family.add(one)
    before = family.levels()
    real, calls = family.write, []

    def write(rows):
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("lost")
        return real(rows)

    monkeypatch.setattr(family, "write", write)
    with pytest.raises(RuntimeError):
        family.add(one)
    assert Family(spark, family.folder).levels() == before


def test_suffixes_are_in_order_of_their_bytes():
    data = data_of("banana split " * 50)
    seed, _, _, _, anchor = runs(data)
    starts = BYTES.starts(data, anchor, seed)
    first = [bytes(data[a : a + 3]) for a in anchor]
    assert [first[i] for i in np.argsort(starts, kind="stable")] == sorted(first)
    assert Units(5, 2, True).of("a b a").tolist() == IN_WORDS.of("a b a").tolist()


@pytest.mark.parametrize("fixture", ["awkward", "clashing"])
def test_defined_results(request, fixture):
    got = cleaned(request.getfixturevalue(fixture)).collect()
    assert order([tuple(r)[:5] for r in got]) == order(brute([r[:2] for r in AWKWARD]))
    assert order([(r.doc_id, r.n_passage_words) for r in got]) == order(brute_words([r[:2] for r in AWKWARD]))


def test_empty(empty):
    assert cleaned(empty).count() == 0


def test_equal_passages_have_equal_anchors():
    r = np.random.default_rng(2)
    a = r.integers(0, 256, 5000).astype(np.uint8)
    b = np.concatenate([r.integers(0, 256, 777).astype(np.uint8), a[1000:2000]])
    place = []
    for x in (a, b):
        _, _, first, count, anchor = runs(x)
        assert count.sum() == len(x) - 399
        place.append(np.repeat(anchor, count))
    assert (place[0][1000:1601] - 1000 == place[1][777:1378] - 777).all()
    assert (sliding_min(np.array([3, 1, 2, 5, 4, 0]), 3) == [1, 1, 2, 0]).all()
    assert data_of("é").tolist() == [195, 169]


def test_short_texts_are_looked_at_together(monkeypatch):
    """Suffixes of many short texts, found in one stretch, are those of each text alone; before, each had its own pass."""
    rng = random.Random(5)
    texts = ["", " ", "é" * 300, "a b " * 150, " x" * 60 + " ", "y" * 399, "z" * 400, *("".join(rng.choice("ab cdé\n") for _ in range(rng.randrange(1200))) for _ in range(60))]
    raw = [t.encode() for t in texts]
    calls = []
    monkeypatch.setattr(suffix, "seeds_of", lambda data, width, f=suffix.seeds_of: calls.append(1) or f(data, width))
    for units in (BYTES, IN_WORDS):
        alone = [runs(units.of(t), units.length, units.seed) for t in texts]
        for size, stretches in ((1 << 17, 1), (4000, None), (1, None)):
            calls.clear()
            found = []
            for a, b in suffix.together(raw, size):
                data, ends = units.joined(raw[a:b])
                seed, whole, first, count, anchor = suffix.runs_in(data, ends, units.length, units.seed)
                start = np.concatenate([[0], ends])[np.searchsorted(ends, first, "right")]
                found.append((seed, whole, first - start, count, anchor - start))
            assert stretches is None or len(calls) == stretches
            for i in range(5):
                assert np.concatenate([f[i] for f in found]).tolist() == np.concatenate([x[i] for x in alone]).tolist()
    assert list(suffix.together([b"aa", b"b", b"cccc", b"", b"d"], 3)) == [(0, 2), (2, 3), (3, 5)]
