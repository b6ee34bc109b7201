import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallymark.llm import pii, toxicity
from tallymark.llm.minhash import deduplicated
from tallymark.llm.mixing import applied
from tests.llm.conftest import AWKWARD, DOCS
from tests.llm.test_minhash import brute
from tests.llm.test_tokens_packing_mixing import ids


def plain_kernel(a, b):
    """The kernel by listing subsequences."""

    def features(word):
        code = toxicity.codes([word])[0].tolist()
        out, square = defaultdict(float), 0.0
        for i, j, k in itertools.combinations(range(len(code)), 3):
            if k - i < toxicity.SPAN:
                w = toxicity.DECAY ** (k - i + 1)
                out[code[i], code[j], code[k]] += w
                square += w * w
        return {f: v / square**0.5 for f, v in out.items()}

    x, y = features(a), features(b)
    return sum(v * y.get(f, 0) for f, v in x.items())


def test_kernel_equals_that_of_listed_subsequences():
    words = ["idiot", "id-iot", "idxiot", "moron", "a", "élan", "aaaa"]
    got = toxicity.Landmarks(words).kernel(words)
    want = [[plain_kernel(a, b) for b in words] for a in words]
    assert got == pytest.approx(np.array(want), abs=1e-5)
    assert got[0, 1] > 0.4 > got[0, 3]


def labelled(n=700, seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["ta", "re", "no", "li", "es", "un", "or"]) for _ in range(r.randrange(1, 4)))
    rows, labels = [], []
    for i in range(n):
        words, toxic = [word() for _ in range(r.randrange(20, 60))], i % 4 == 0
        if toxic:
            bad = r.choice(["gromp", "fizbat"]) + r.choice(["", "ta", "es"])
            if r.random() < 0.3:
                at = r.randrange(1, len(bad))
                bad = bad[:at] + r.choice("-*x") + bad[at:]
            words[r.randrange(len(words))] = bad
        rows.append((i, " ".join(words) + ".", "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy_with_inserted_characters(spark):
    rows, labels = labelled()
    docs, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    machine = toxicity.trained(docs, lab)
    got = {r.doc_id: r for r in toxicity.scored(docs, machine).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()}
    assert {i for i, r in got.items() if r.held} == {i for i in got if zlib.crc32(str(i).encode()) % 5 == 0}
    held = [(r.score >= 0.5, bool(labels[i][2])) for i, r in got.items() if r.held]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert "idiot" in toxicity.spelled("you are an i d i o t okay".split()) and not toxicity.spelled("de la en el".split())
    assert toxicity.sentences("One two. Three\nfour? 5.5 six") == [["One", "two."], ["Three"], ["four?"], ["5.5", "six"]]


def test_training_stays_out_of_the_driver(spark, monkeypatch):
    rows, labels = labelled()
    docs, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want, here, real = toxicity.train(*toxicity.training_documents(docs, lab)), [], toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda *texts: here.append(len(texts)) or real(*texts))
    got = toxicity.trained(docs.repartition(3), lab)
    assert not here
    flagged = [m.score(m.documents(pa.array([r[1] for r in rows], pa.large_string()))) >= 0.5 for m in (got, want)]
    assert (flagged[0] == flagged[1]).mean() > 0.99 and (got.clean == want.clean).all()


def test_copies_with_a_label_teach_nothing_but_once(spark):
    """A toxic document in many near copies: its ordinary words are no evidence against clean documents."""
    rows, labels = labelled()
    r = random.Random(9)
    base = [f"{a}{b}ek" for a in "tare noli esun orta".split() for b in "abcdefghi"] * 2
    for i in range(5000, 5150):
        words = list(base)
        words[r.randrange(len(words))] = f"q{i}"
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, 1))
    rows.append((9000, " ".join(base[3:20]), "en", "s", 0))
    docs = spark.createDataFrame(rows, DOCS)
    machine = toxicity.trained(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.scored(docs.where("doc_id < 700 OR doc_id = 9000"), machine).collect()}
    assert got[9000] < 0.5 and sum(got[i] >= 0.5 for i, _, t in labels[:700] if not t) <= 5


def test_one_text_of_an_id_teaches_and_labels_that_disagree_do_not(spark):
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    docs = [(i, f"text {n} of {i}") for i in ids for n in range(3)]
    labels = [(i, i % 2) for i in ids[4:]] + [(ids[0], 0), (ids[0], 1), (ids[1], 1), (ids[1], 1), (ids[2], None), (None, 1)]
    frames = [spark.createDataFrame(d, "doc_id long, text string") for d in (docs, docs[::-1])]
    found = [toxicity.training_documents(d.repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int")) for d in frames]
    assert found[0] == found[1]
    of = [sorted(int(t.split()[-1]) for t in kind) for kind in found[0]]
    assert of == [sorted(i for i in ids[4:] if i % 2 == 0), sorted([ids[1], *(i for i in ids[4:] if i % 2)])]


def test_sentences_with_evidence_train_the_machine():
    r = random.Random(2)
    clean = [" ".join(f"w{r.choice('abcdefgh')}{r.choice('iouy')}x" for _ in range(30)) + ". You are a friend today." for i in range(80)]
    toxic = [f"{t} You are a gromp{'-' * (i % 3)}ler today." for i, t in enumerate(clean[:40])]
    machine = toxicity.train(clean[40:], toxic)
    assert machine.document("You grompler") > 0 > machine.document("You are a wbox today.")
    assert toxicity.train(clean, clean) is None and toxicity.train([], toxic) is None


GAPS = ["g-r-o-m-p", "g--r--o--m--p", "g***r***o***m***p", "gxrxoxmxp", "gro mp", "g r om p", "g. r. o. m. p.", "g * r * o * m * p", "fi zbat", "fiz--bat", "f_i z b_at"]


def test_gaps_of_many_characters_and_white_space(spark):
    rows, labels = labelled()
    machine = toxicity.trained(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    clean = "tare noli esun or tata reno lies un orta"
    texts = [clean, *[f"{clean} {gap} {clean}" for gap in GAPS]]
    got = toxicity.scored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), machine).orderBy("doc_id").collect()
    assert [r.score >= 0.5 for r in got] == [False, *[True] * len(GAPS)]
    word = toxicity.Landmarks(["idiot"]).kernel(["i---d---i---o---t", "m---o---r---o---n"])[:, 0]
    assert word[0] > word[1] == 0  # three letters with three between each two are in one window


def test_margins_equal_those_through_landmarks():
    marks, words = ["idiot", "moron", "clean"], ["id-iot", "", "a", "mo--ron", "x" * 3_000]
    landmarks = toxicity.Landmarks(marks)
    of = np.array([0.5, 1.0, -0.7], np.float32)
    machine = toxicity.Machine(landmarks.weights(of), -0.2)
    assert machine.margins(words) == pytest.approx(landmarks.kernel(words) @ of - 0.2, abs=1e-4)


def test_toxicity_defined_results(spark, clashing, empty):
    rows, labels = labelled(300)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    machine = toxicity.trained(spark.createDataFrame(rows, DOCS), lab)
    out = toxicity.scored(clashing, machine).collect()
    assert len(out) == len(AWKWARD) and all(0 <= r.score < 0.5 for r in out)
    assert toxicity.trained(empty, lab) is None
    assert {r.score for r in toxicity.scored(clashing, None).collect()} == {0.0}
    assert toxicity.scored(empty, machine).count() == 0 and toxicity.accepted(empty, machine).columns == empty.columns
    kept = toxicity.accepted(clashing, machine)
    assert kept.columns == clashing.columns and kept.count() == len(AWKWARD)


def test_pipeline_against_plain_stages(spark, tmp_path):
    rows, labels = labelled(240)
    extra = " ".join(f"w{i}" for i in range(80))
    rows += [(1000 + i, extra.replace("w7 ", f"v{i} "), "en", "s1", 0) for i in range(12)]
    rows += [(2000, "mail jo@host.com or +1 (415) 555-0142 soon", "en", None, 0), (2001, None, "en", None, 0), (2002, "", "en", "s2", 0), (2002, "", "en", "s2", 0)]
    spark.createDataFrame(rows, DOCS).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, steps = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        steps[name] = docs.collect()
    toxic = {i for i, _, t in labels if t}
    clean = [r for r in rows if r[0] not in toxic]
    left = {r.doc_id for r in steps["toxicity"]}
    assert {r[0] for r in clean} - left == set() and len(left & toxic) <= 0.1 * len(toxic)
    given = [(r.doc_id, r.text) for r in steps["toxicity"]]
    assert len(steps["near_duplicates"]) == len({frozenset(given[i][0] for i in c) for c in brute(given)})
    assert sum(r.doc_id >= 1000 and r.doc_id < 2000 for r in steps["near_duplicates"]) == 1
    text = {r.doc_id: r for r in steps["personal_data"]}
    assert text[2000].text == "mail [email] or [phone] soon" and text[2000].n_chars == len(text[2000].text)
    sizes = defaultdict(int)
    for r in steps["personal_data"]:
        sizes[r.source] += len((r.text or "").split())
    taken = defaultdict(int)
    for r in steps["mixing"]:
        taken[r.source] += len((r.text or "").split())
    assert sum(taken.values()) == pytest.approx(sum(sizes.values()), abs=200)
    assert all(taken[s] <= 3 * sizes[s] for s in taken)
    assert sum(r.length for r in steps["packing"]) == sum(len(ids(r.text)) for r in steps["mixing"])


def test_stages_take_awkward_and_empty_tables(spark, clashing, empty):
    assert deduplicated(clashing).columns == clashing.columns
    assert deduplicated(clashing).count() == len({frozenset(c) for c in brute([(r[0], r[1]) for r in AWKWARD])})
    assert applied(clashing).columns == clashing.columns
    for f in (deduplicated, applied, pii.redacted):
        assert f(empty).count() == 0


def test_pipeline_over_empty_and_awkward_tables(spark, tmp_path):
    for name, rows in (("none", []), ("odd", AWKWARD)):
        folder = tmp_path / name
        spark.createDataFrame(rows, DOCS).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
        out = corpus_pipeline.run(spark, str(folder))
        assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        assert (out.count() > 0) == bool(rows)
