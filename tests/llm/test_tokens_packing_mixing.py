import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallymark.llm import packing, tokens
from tallymark.llm.mixing import hashed, mixed
from tallymark.llm.common import n_words, new_path, written
from tallymark.llm.packing import packed, plan
from tallymark.llm.tokens import Encoder, token_report, write_tokens, read_tokens
from tests.llm.conftest import AWKWARD

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)
FAST = Encoder(PATH, max_entries=50)


def ids(text):
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, 2]


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"ab .,\n\t'sé1東<|>", "\u3000", "\u00a0", "<|endoftext|>", "  "]), max_size=40).map("".join))
def test_chunked_encoding_equals_plain_encoding(text):
    assert FAST.encode(text).tolist() == PLAIN.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.lists(st.sampled_from([*"ab .,\n\t'sé1東<|>", "\u3000", "\u00a0", "<|endoftext|>", "  ", " some", " words,", "\x1c"]), max_size=30).map("".join), max_size=8))
def test_encoding_many_texts_equals_plain_encoding(texts):
    flat, at = FAST.encode_all(pa.array(texts, pa.string()), 2)
    assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == [ids(t) for t in texts]


def test_texts_are_encoded_in_parts(monkeypatch):
    monkeypatch.setattr(tokens, "PART_BYTES", 20)
    texts = ["one two three", "", "a longer text than a part holds, by far", None, "x"]
    flat, at = FAST.encode_all(pa.array(texts, pa.string()), 2)
    assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == [ids(t) for t in texts]


@pytest.mark.parametrize("fixture", ["awkward", "clashing"])
def test_token_files_round_trip(spark, request, fixture):
    path = new_path(spark, "t")
    write_tokens(request.getfixturevalue(fixture), path, PATH)
    want, at = [], 0
    for doc, text, *_ in sorted(AWKWARD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        want.append((doc, at, len(ids(text)), crc(ids(text))))
        at += len(ids(text))
    got = [tuple(r) for r in token_report(spark, path).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    stored = {r.doc_id: r.ids for r in read_tokens(spark, path).where("doc_id = 6").collect()}
    assert stored[6] == ids(AWKWARD[5][1])


def test_empty_tables(spark, empty):
    path = new_path(spark, "t")
    write_tokens(empty, path, PATH)
    assert token_report(spark, path).count() == 0
    assert packed(empty, PATH).count() == 0
    assert mix(empty).count() == 0


@pytest.mark.parametrize("fixture", ["awkward", "clashing"])
def test_packing_is_whole_and_gapless(request, fixture):
    rows = packed(request.getfixturevalue(fixture), PATH).collect()
    want = []
    for doc, text, *_ in AWKWARD:
        x = ids(text)
        cuts = [0, *range(len(x) % 1024 or 1024, len(x) + 1, 1024)]
        want += [(doc, k, a, b - a, crc(x[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    order = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=order) == sorted(want, key=order)
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for v in by.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 1024


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=30))
def test_plan_uses_every_piece_once_within_capacity(counts):
    used = defaultdict(int)
    for times, lengths in plan(counts, 64):
        assert times > 0 and sum(lengths) <= 64
        for x in lengths:
            used[x] += times
    assert dict(used) == counts


def test_exact_complements_fill_sequences():
    assert sorted(plan({1000: 2, 24: 1, 12: 2}, 1024)) == [(1, (1000, 12, 12)), (1, (1000, 24))]
    assert plan({900: 3, 62: 6}, 1024) == [(3, (900, 62, 62))]
    assert plan({700: 1, 200: 1, 100: 1, 24: 1}, 1024) == [(1, (700, 200, 100, 24))]


def mix(docs):
    from pyspark.sql import functions as F

    return mixed(written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), hashed(F.col("doc_id")).alias("hash")), "sizes"))


def test_mixing_defined_results(awkward):
    rows = mix(awkward).collect()
    assert len(rows) == len(AWKWARD)
    for r in rows:
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        assert r.target <= 3 * r.source_size + 1e-9
    assert {r.source_size for r in rows if r.source is None} == {4}
    assert sum({r.source: r.target for r in rows}.values()) == pytest.approx(sum({r.source: r.source_size for r in rows}.values()))


def test_mixing_comes_near_targets_and_reruns_agree(spark):
    rows = [(i, "w " * (1 + i % 7), "en", None if i % 10 == 9 else f"s{i % 3 if i % 5 else 0}", 0) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    a, b = [{(r.doc_id, r.taken) for r in mix(d).collect()} for d in (docs, docs.repartition(7))]
    assert a == b
    got = defaultdict(int)
    for r in (out := mix(docs).collect()):
        got[r.source] += r.taken
    for r in out:
        assert abs(got[r.source] - r.target) <= 7


@pytest.mark.parametrize("ids_", [[-(1 << 62), -5, None, 0, 7, 7, 8, 9, 10, 11, (1 << 62)], list(range(1000, 0, -1)), [5] * 20, [None]])
def test_files_are_in_order_of_any_ids(spark, ids_):
    docs = spark.createDataFrame([(i, f"text {k}") for k, i in enumerate(ids_)], "doc_id long, text string").repartition(3)
    path = new_path(spark, "t")
    write_tokens(docs, path, PATH)
    got = [r.doc_id for r in token_report(spark, path).orderBy("start").collect()]
    assert got == sorted(ids_, key=lambda i: (i is not None, i or 0))


def fewest(lengths, capacity):
    """The least number of sequences by trying every way."""
    best = len(lengths)

    def place(i, gaps):
        nonlocal best
        if len(gaps) >= best:
            return
        if i == len(lengths):
            best = len(gaps)
            return
        for g in {x for x in gaps if x >= lengths[i]}:
            k = gaps.index(g)
            place(i + 1, [*gaps[:k], g - lengths[i], *gaps[k + 1 :]])
        place(i + 1, [*gaps, capacity - lengths[i]])

    place(0, [])
    return best


def test_plan_needs_hardly_more_sequences_than_the_best_packing():
    r = random.Random(11)
    more = 0
    for _ in range(200):
        capacity = r.choice([10, 16, 24])
        lengths = sorted((r.randrange(1, capacity + 1) for _ in range(r.randrange(1, 10))), reverse=True)
        n = sum(k for k, _ in plan(Counter(lengths), capacity))
        assert n <= fewest(lengths, capacity) + 1
        more += n - fewest(lengths, capacity)
    assert more <= 4


@pytest.mark.parametrize("ids_", [[*range(20_000), 1 << 60], [*range(3000), -(1 << 63), (1 << 63) - 1], [5] * 300 + [7], [None, 3, None, 1], [1, 2, 3] * 50 + [10**12 + i for i in range(4000)], [2**i for i in range(63)]])
def test_far_ids_do_not_put_the_others_in_one_partition(spark, ids_):
    """Partitions ascend, and hold at most their share and what one id has."""
    df = spark.createDataFrame([(i, "x") for i in ids_], "doc_id long, text string")
    parts = defaultdict(list)
    for r in tokens.ranged(df).select("doc_id", F.spark_partition_id().alias("p")).collect():
        parts[r.p].append((r.doc_id is not None, r.doc_id or 0))
    in_order = [sorted(parts[p]) for p in sorted(parts)]
    assert [x for p in in_order for x in p] == sorted((i is not None, i or 0) for i in ids_)
    most = max(Counter(ids_).values())
    assert max(map(len, in_order)) <= 2 * -(-len(ids_) // 4) + most


def test_ranks_are_the_same_in_any_number_of_windows(spark, monkeypatch):
    rows = [(i // 2, i % 2, 0, 5 if i % 3 else 9, i % 7) for i in range(400)] + [(None, 0, 0, 5, 1)] * 3
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    counts = {r["length"]: r["count"] for r in df.groupBy("length").count().collect()}
    found = []
    for most in (200_000, 4, 1):
        monkeypatch.setattr(packing, "RANK_ROWS", most)
        found.append(sorted((tuple(r) for r in packing.ranked(df, counts).select("length", "rank", "doc_id", "piece", "ids_crc32").collect()), key=str))
    assert found[0] == found[1] == found[2]
    for length, n in counts.items():
        assert sorted(r[1] for r in found[0] if r[0] == length) == list(range(n))
