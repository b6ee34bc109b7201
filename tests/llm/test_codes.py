import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.llm import codes
from tallymark.llm.codes import LEAF, Tree, compressed

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, entries=256, parts=4, rounds=4):
    """Lloyd's rounds in Python's integers: every part against every entry. Rows are ``(vec_id, vector, label)``."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(rows[0][1]) if rows else 0
    fits = [r for r in rows if len(r[1]) == size]
    whole = [[math.floor(float(np.float32(x)) * 1024) for x in r[1]] for r in fits]
    cut = [(size * i // parts, size * (i + 1) // parts) for i in range(parts)]
    books = [[w[a:b] for w in whole[:entries]] for a, b in cut]
    far = lambda x, c: sum((p - q) ** 2 for p, q in zip(x, c))
    near = lambda x, book: min(range(len(book)), key=lambda e: (far(x, book[e]), e))
    for _ in range(rounds):
        for p, (a, b) in enumerate(cut):
            own = {}
            for w in whole:
                own.setdefault(near(w[a:b], books[p]), []).append(w[a:b])
            books[p] = [[sum(c) // len(own[e]) for c in zip(*own[e])] if e in own else old for e, old in enumerate(books[p])]
    out = []
    for r, w in zip(fits, whole):
        e = [near(w[a:b], book) for (a, b), book in zip(cut, books)]
        out.append((r[0], r[2], "".join(f"{i:02x}" for i in e), sum(far(w[a:b], book[i]) for i, (a, b), book in zip(e, cut, books))))
    out += [(r[0], r[2], None, None) for r in rows if len(r[1]) != size]
    errors = {}
    for r in out:
        if r[3] is not None:
            errors[r[1]] = errors.get(r[1], 0) + r[3]
    return sorted(((i, c, e, errors.get(label)) for i, label, c, e in out), key=str), [[list(x) for x in b] for b in books]


def got(df, **options):
    out, books = compressed(df, **options)
    rows = sorted((tuple(r) for r in out.select("vec_id", "code", "error", "label_error").collect()), key=str)
    return rows, [[[int(x) for x in e] for e in b] for b in books]


def vectors(n, size, seed, spread=1.0):
    r = random.Random(seed)
    centres = [[r.gauss(0, spread) for _ in range(size)] for _ in range(12)]
    return [(i * 3, [c + r.gauss(0, 0.03) for c in r.choice(centres)], r.choice([1, 2, 2, 2, None])) for i in range(n)]


@pytest.mark.parametrize(("n", "size", "entries"), [(900, 16, 20), (40, 8, 256), (700, 64, 9)])
def test_equal_to_every_part_against_every_entry(spark, n, size, entries):
    rows = vectors(n, size, n)
    assert got(spark.createDataFrame(rows, VECTORS), entries=entries) == brute(rows, entries)


def test_ties_repeats_and_coarse_vectors(spark):
    r = random.Random(5)
    rows = [(r.randrange(200), [r.randrange(3) / 1024 for _ in range(8)], r.randrange(3)) for _ in range(600)]
    rows += rows[:50]
    assert got(spark.createDataFrame(rows, VECTORS), entries=30) == brute(rows, 30)


def test_defined_results(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(60, 10, 3) + [(None, [0.5] * 10, None), (900, None, 1), (901, [nan] * 10, 1), (902, [inf] + [0.0] * 9, 1), (903, [None] + [0.0] * 9, 1), (904, [1.0] * 3, 2), (905, [], 7), (906, [-0.0004] * 10, 1)]
    df = spark.createDataFrame(rows, VECTORS).withColumns({n: F.lit("x") for n in ("code", "error", "label_error", "ids", "trees", "_label")})
    assert got(df, entries=16) == brute(rows, 16)
    assert compressed(spark.createDataFrame([], VECTORS))[0].count() == 0
    assert got(spark.createDataFrame([(1, [], 1), (2, [], 1)], VECTORS)) == ([(1, "00000000", 0, 0), (2, "00000000", 0, 0)], [[[]] * 2] * 4)
    with pytest.raises(ValueError):
        compressed(df, entries=257)


def test_numbers_beyond_doubles_are_exact(spark):
    """Components whose squares are beyond what doubles hold exactly, among small ones."""
    r = random.Random(8)
    rows = [(i, [r.choice([1e5, 1.0, 3e5]) + r.random() for _ in range(4)], 1) for i in range(120)]
    assert got(spark.createDataFrame(rows, VECTORS), entries=7, rounds=2) == brute(rows, 7, rounds=2)
    rows = [(i, [r.choice([1e6, 1e5]) + r.random() for _ in range(8)], 1) for i in range(30)]
    assert got(spark.createDataFrame(rows, VECTORS), entries=5, rounds=2) == brute(rows, 5, rounds=2)


def test_labels_beyond_the_broadcast(spark, monkeypatch):
    rows = vectors(90, 8, 4)
    monkeypatch.setattr(codes, "BROADCAST_LABELS", 1)
    assert got(spark.createDataFrame(rows, VECTORS), entries=8) == brute(rows, 8)


def test_blocks_do_not_change_the_result(spark, monkeypatch):
    rows = vectors(500, 16, 6)
    want = brute(rows, 16)
    monkeypatch.setattr(codes, "BLOCK", 37)
    assert got(spark.createDataFrame(rows, VECTORS).repartition(3), entries=16) == want


def test_whole_subtrees_go_to_one_entry():
    """Far clusters: nodes above the leaves are assigned by their boxes, from cached sums."""
    r = np.random.default_rng(1)
    centres = np.array([[0, 0], [9000, 0], [0, 9000], [9000, 9000]])
    x = np.floor(np.repeat(centres, 256, 0) + r.integers(-50, 50, (1024, 2))).astype(float)
    tree = Tree.built(x)
    assert Tree.depth(1024) == 6 and len(tree.low) == 127 and LEAF == 16
    points = tree.points
    tree.points = np.full_like(points, np.nan)  # looked at only in leaves with more than one entry left
    code, sums, counts = tree.assigned(centres.astype(float))
    far = ((x[tree.order][:, None] - centres) ** 2).sum(2)
    assert (code == far.argmin(1)).all() and counts.tolist() == [256] * 4
    assert (sums == np.array([points[code == i].sum(0) for i in range(4)])).all()


def test_nodes_hold_the_box_and_sum_of_their_points():
    x = np.floor(np.random.default_rng(2).normal(0, 300, (333, 5)))
    tree = Tree.built(x)
    depth = Tree.depth(333)
    for level in range(depth + 1):
        for j in range(1 << level):
            own, at = tree.points[333 * j >> level : 333 * (j + 1) >> level], (1 << level) - 1 + j
            assert 0 < len(own) and (tree.low[at] == own.min(0)).all() and (tree.high[at] == own.max(0)).all() and (tree.total[at] == own.sum(0)).all()
    assert sorted(tree.order.tolist()) == list(range(333)) and (x[tree.order] == tree.points).all()
