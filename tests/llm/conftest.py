import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


DOCS = "doc_id long, text string, lang string, source string, n_chars long"

AWKWARD = [
    (1, "Plain words, and more words.\nA second line.", "en", "a", 44),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (4, "x" * 30_000 + " " + "many words " * 4_000, "en", "b", 74_001),
    (5, "  two  blanks \n \n\n tabs\t \t end ", "en", "b", 32),
    (6, "naïve café – 東京 🙂🙂 don't we'll 123abc", "fr", "b", 38),
    (7, "Plain words, and more words.\nA second line.", "en", "c", 44),
    (7, "Plain words, and more words.\nA second line.", "en", "c", 44),
    (None, "no id at all", None, None, 12),
    (8, " \n", "en", "c", 2),
]


@pytest.fixture
def awkward(spark):
    return spark.createDataFrame(AWKWARD, DOCS)


@pytest.fixture
def clashing(awkward):
    """Columns that carry the names operators use inside."""
    from pyspark.sql import functions as F

    names = ["size", "hash", "part", "place", "rank", "length", "piece", "start", "key", "band", "words", "_salt", "source_size", "target", "taken", "n_tokens", "ids", "score", "spans", "fingerprint"]
    return awkward.withColumns({n: F.lit("x") for n in names})


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)
