import random
import tracemalloc
import weakref
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tallymark.llm import common
from tallymark.llm.minhash import BANDS, K, Bucket, deduplicated, elements, grouped, signature, similarity
from tests.llm.conftest import AWKWARD, DOCS


def shingle_set(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else frozenset()


def brute(rows, similar=0.8):
    """Classes by comparing every two texts that share a shingle."""
    parent = {i: i for i in range(len(rows))}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets, by = [shingle_set(t) for _, t in rows], defaultdict(list)
    for i, s in enumerate(sets):
        for x in s or {("empty",)}:
            by[x].append(i)
    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for x in s or {("empty",)}:
            for j in by[x]:
                shared[j] += j < i
        for j, n in shared.items():
            if n and (not s or n / (len(s) + len(sets[j]) - n) >= similar):
                parent[max(top(i), top(j))] = min(top(i), top(j))
    return {frozenset(k for k in range(len(rows)) if top(k) == r) for r in map(top, range(len(rows)))}


def classes(df):
    by = defaultdict(set)
    for r in df.collect():
        by[r.class_id].add(r.doc_id)
    return {frozenset(v) for v in by.values()}


def corpus(n=120, seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    rows = []
    for _ in range(n):
        base = [word() for _ in range(r.choice([3, 5, 20, 120, 400]))]
        rows.append(" ".join(base))
        for _ in range(r.choice([0, 0, 1, 3])):
            w = list(base)
            for _ in range(r.choice([0, 1, 2, 6])):
                w[r.randrange(len(w))] = word()
            rows.append(" ".join(w))
    base = [word() for _ in range(300)]
    for _ in range(60):  # a chain of copies, each a little further away
        base = list(base)
        base[r.randrange(300)] = word()
        rows.append(" ".join(base))
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("tile", [24 << 20, 20_000])
def test_classes_equal_those_of_all_pairs(spark, tile):
    rows = corpus()
    got = classes(grouped(spark.createDataFrame(rows, "doc_id long, text string"), tile=tile))
    assert got == brute(rows)


@pytest.mark.parametrize("tile", [24 << 20, 60_000])
def test_one_group_of_near_copies(spark, tile):
    """Most pairs are just under or just over the limit, and none is missed or listed twice."""
    r = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(3):
            w[r.randrange(120)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert classes(grouped(df, tile=tile)) == brute(rows)


def test_a_repeated_id_does_not_join_other_texts(spark):
    rows = [(1, "one two three four five six"), (1, "alpha beta gamma delta epsilon"), (2, "alpha beta gamma delta epsilon"), (2, "one two three four five six"), (None, "some other words stand here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.same: r.class_id for r in grouped(df).collect()}
    assert len(found) == 3 and len(set(found.values())) == 3
    assert deduplicated(df).count() == 3


@pytest.mark.parametrize("fixture", ["awkward", "clashing"])
def test_defined_results(request, fixture):
    rows = grouped(request.getfixturevalue(fixture)).collect()
    assert len(rows) == len(AWKWARD)
    of = {r.doc_id: r.class_id for r in rows}
    assert of[1] == of[7] == 1
    assert of[2] == of[3] == of[8] == 2
    assert of[4] == 4 and of[5] == 5 and of[6] == 6
    assert sum(r.is_first for r in rows if r.class_id == 1) == 1


def test_empty(spark, empty):
    assert grouped(empty).count() == 0
    one = spark.createDataFrame([(5, "alone", None, None, 5)], DOCS)
    assert [(r.doc_id, r.class_id) for r in grouped(one).collect()] == [(5, 5)]


@pytest.mark.parametrize("weighted", [False, True])
def test_signatures_agree_as_often_as_sets_are_similar(weighted):
    r = np.random.default_rng(5)
    a = r.integers(0, 1 << 63, 80).astype(np.uint64)
    w = r.uniform(0.3, 6, 80) if weighted else np.ones(80)
    v = w * r.uniform(0.5, 1, 80) if weighted else np.ones(80)
    b, c = (a, v) if weighted else (a[20:], v[20:])
    want = np.minimum(w, v).sum() / np.maximum(w, v).sum() if weighted else 60 / 80
    got = np.mean([(signature(a + np.uint64(i), w) == signature(b + np.uint64(i), c)).mean() for i in range(40)])
    assert got == pytest.approx(want, abs=0.03)


def test_similarity_is_jaccards():
    x, y = "a b c d e f g h i j", "a b c d e f g h i k"
    assert similarity(elements(x), elements(y)) == pytest.approx(5 / 7)


@pytest.mark.parametrize("weighted", [False, True])
def test_a_bucket_takes_few_times_its_shingles(weighted):
    """Before, copies of all shingles took eight times their bytes at once, in each of an executor's workers."""
    rng, n, size = np.random.default_rng(1), 100, 5000
    sets = [np.unique(rng.integers(0, 50_000, size).astype(np.uint64) << np.uint64(40)) for _ in range(n)]
    weights = [rng.integers(1, 9, len(x)).astype(np.float32) for x in sets]
    rows = pa.table({
        "key": [7] * n, "id": list(range(n)), "class": list(range(n)), "query": pa.array([True] * n).to_numpy(False), "target": pa.array([True] * n).to_numpy(False),
        "sig": pa.array([bytes(2 * K)] * n, pa.binary()), "bands": [[7] * BANDS] * n,
        "elements": pa.chunked_array([pa.array([x.tobytes() + (w.tobytes() if weighted else b"") for x, w in zip(sets[a:b], weights[a:b])], pa.binary()) for a, b in ((0, 30), (30, n))]),
    })
    tracemalloc.start()
    bucket = Bucket(rows, weighted)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    x = np.concatenate(sets)
    assert most < 5 * x.nbytes
    assert (bucket.codes == np.unique(x, return_inverse=True)[1]).all()
    assert bucket.ends.tolist() == np.cumsum([0, *map(len, sets)]).tolist()
    assert (bucket.weights == (np.concatenate(weights) if weighted else 1)).all()


def test_a_worker_gives_memory_back_after_a_task(monkeypatch):
    """Workers live on beside the next stages; what a task held is gone when its memory is given back."""

    class Held:
        pass

    held, alive = [], []
    monkeypatch.setattr(common, "freed", lambda: alive.append(held[0]() is not None))

    def run(batches):
        for batch in batches:
            own = Held()
            held.append(weakref.ref(own))
            yield batch

    assert list(common.releasing(run)(iter([1]))) == [1]
    assert alive == [False]
    monkeypatch.undo()
    common.freed()
