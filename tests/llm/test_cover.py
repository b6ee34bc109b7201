import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.llm.cover import COVERS, LAST, Windows, cleaned
from tallymark.llm.hashing import Ranges, words
from tests.llm.conftest import AWKWARD

SCHEMA = "doc_id long, text string"


def brute(rows, length):
    """Every passage of every document, with the least document that has it."""
    said = [(LAST if d is None else d, d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for i, _, w in said:
        for a in range(len(w) - length + 1):
            p = tuple(w[a : a + length])
            first[p] = min(first.get(p, i), i)
    out = []
    for i, d, w in said:
        gone = np.zeros(len(w), bool)
        for a in range(len(w) - length + 1):
            if first[tuple(w[a : a + length])] < i:
                gone[a : a + length] = True
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df, windows=Windows()):
    return sorted((tuple(r) for r in cleaned(df, windows).drop("kept").collect()), key=str)


@pytest.mark.parametrize("period", sorted(COVERS))
def test_a_cover_meets_every_pair_of_places(period):
    cover = set(COVERS[period])
    for a in range(period):
        assert any((k % period) in cover and (k + a) % period in cover for k in range(period))
    w = Windows(period + 4, period)
    for n in range(3 * period):
        at = set(w.anchors(n).tolist())
        for start in range(n - w.length + 1):
            through = [a for a in at if start <= a < start + period]
            assert len(through) == len(cover) and all(w.first(np.array([a]))[0] <= start <= w.last(np.array([a]), n)[0] for a in through)


@pytest.mark.parametrize(("length", "period"), [(50, 31), (9, 7), (14, 13)])
def test_equal_to_all_passages(spark, length, period):
    r = random.Random(length)
    fresh = lambda n: [r.choice(["a", "be", "to", "é"]) + str(r.randrange(3 if length < 20 else 400)) for _ in range(n)]
    shared = [fresh(n) for n in (length - 1, length, length + 1, 2 * length, 5 * length)]
    texts = [[*fresh(r.randrange(90)), *r.choice(shared), *fresh(r.randrange(90))] for _ in range(80)]
    for _ in range(40):  # copies with an edit
        t = list(r.choice(texts))
        t[r.randrange(len(t))] = "#"
        texts.append(t)
    texts += [r.choice(texts) for _ in range(10)] + [["same"] * 150, ["same"] * 60, ["x", "y"] * 80, [], shared[4] + fresh(3) + shared[4]]
    r.shuffle(texts)
    rows = [(i // 2 * 2 if i % 9 == 0 else i, r.choice([" ", "\n", " \t "]).join(t)) for i, t in enumerate(texts)]  # some ids twice
    rows += [(None, " ".join(shared[3])), (None, " ".join(shared[3])), (None, None), (500, None)]
    assert got(spark.createDataFrame(rows, SCHEMA), Windows(length, period)) == brute(rows, length)


def test_one_passage_in_very_many_documents_and_near_copies(spark):
    """Every document has another reach around the passage, or is a copy with its own edit."""
    r = random.Random(2)
    fresh = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    common, long = fresh(70), fresh(300)
    rows = [(i, " ".join([*fresh(5), *common, *fresh(5)])) for i in range(300)]
    rows += [(1000 + i, " ".join([*long[: i + 1], "edit", *long[i + 1 :]])) for i in range(200)]
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute(rows, 50)


@pytest.mark.parametrize("fixture", ["awkward", "clashing"])
def test_defined_results(request, fixture):
    df = request.getfixturevalue(fixture).withColumns({n: F.lit("x") for n in ("id", "tag", "at", "rows", "full")})
    assert got(df) == brute([x[:2] for x in AWKWARD], 50)


def test_empty(empty):
    assert cleaned(empty).count() == 0


def test_ranges_of_equal_units_have_equal_hashes_and_signs_that_cancel_modulo_two_do_not():
    signs = np.array([i.bit_count() & 1 for i in range(2048)])
    a, b = (97 + signs).astype(np.uint8), (98 - signs).astype(np.uint8)
    zero, end = np.array([0]), np.array([2048])
    assert Ranges(a).of(zero, end) != Ranges(b).of(zero, end) and words(bytes(a).decode())[0] != words(bytes(b).decode())[0]
    text = np.frombuffer(b"one two one two, one", np.uint8)
    r = Ranges(text)
    assert r.of(np.array([0]), np.array([7])) == r.of(np.array([8]), np.array([15])) != r.of(np.array([1]), np.array([8]))
    assert len(set(words("a\x0bb\x1cc a " + "z" * 3_000_000).tolist())) == 3
