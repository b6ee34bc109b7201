import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tallymark.llm.infill import LEAD, MARK, rearranged, restored
from tests.llm.conftest import AWKWARD

COLUMNS = ["doc_id", "n", "form", "output", "restored"]


def brute(doc_id, text):
    """Unit by unit in plain Python."""
    t = text or ""
    g = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(g[i : i + 8], 16) for i in range(0, 32, 8)]
    u = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    if not t or re.search("<[PSM]>", t) or h[2] % 100 >= 50:
        return doc_id, len(u), "plain", t, t
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h[3] % 100 < 80:
        return doc_id, len(u), "spm", f"<S>{s}<P>{p}<M>{m}", t
    return doc_id, len(u), "psm", f"<P>{p}<S>{s}<M>{m}", t


def got(df):
    out = rearranged(df).withColumn("restored", restored(F.col("output"), F.col("form")))
    return sorted((tuple(r) for r in out.select(*COLUMNS).collect()), key=str)


def test_equal_to_units_taken_one_by_one(spark):
    r = random.Random(3)
    alphabet = ["a", "bc", "é", "🙂", " ", "  ", "\n", "\t", "\x0b", MARK, LEAD, LEAD + "m", LEAD + "l", "m", "l", "<", "P>", "<P", "<M", "$0", "\\", " ", "\x00"]
    rows = [(i, "".join(r.choice(alphabet) for _ in range(r.randrange(40)))) for i in range(1500)]
    rows += [(5000 + i, t) for i, t in enumerate(["a <P> b", "<S>", "x<M>y", " ", "\n\n", "one", " one", "one ", MARK * 9, LEAD * 9, "<", "a <P"] * 12)]
    want = sorted((brute(*x) for x in rows), key=str)
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == want
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("fixture", ["awkward", "clashing"])
def test_defined_results(request, fixture):
    df = request.getfixturevalue(fixture).withColumns({"n": F.lit("x"), "_text": F.lit("y")})
    assert got(df) == sorted((brute(x[0], x[1]) for x in AWKWARD), key=str)
    assert "_text" in rearranged(df).columns and rearranged(df).columns.count("n") == 1


def test_very_long_texts_and_shares(spark):
    rows = [(i, "word " * (200_000 if i < 4 else 3) + "end") for i in range(600)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == sorted((brute(*x) for x in rows), key=str)
    all_spm = rearranged(spark.createDataFrame(rows[4:], "doc_id long, text string"), 7, 100, 100)
    assert {r.form for r in all_spm.select("form").distinct().collect()} == {"spm"}


def test_empty_and_no_python(spark, empty):
    assert rearranged(empty).count() == 0
    assert "Python" not in rearranged(empty)._jdf.queryExecution().executedPlan().toString()
