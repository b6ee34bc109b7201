"""Fill-in-the-middle rearrangement of documents, by delimiters put behind every unit of a text.

Method: one character, ``MARK``, is the delimiter. Where a text holds it, it is escaped, so that the escaped text has
none; escapes are made of characters that are no white space, so the units stay the same. One ``regexp_replace`` puts the
delimiter behind every unit, and the number of units is how often it then occurs. A document's digest gives two ranks:
``substring_index`` takes what stands before, between and behind the delimiters of those ranks; delimiters go, escapes are
undone, and the three parts are put together with the markers of the form. Everything is a column expression.

Units are runs of white space (may be none) with the word behind, and white space at the end of a text. ``prefix`` is what
stands before the smaller rank, ``suffix`` what stands behind the larger. A text that holds a marker stays plain, so each
marker of an output occurs in it once and ``restored`` can take it apart.

Defined results: a null text is an empty one, has no units and stays plain; a text of white space alone is one unit. A
null ``doc_id`` counts as an empty string in the digest. Repeated rows give repeated results: the form depends on
``doc_id`` and text alone. Very long texts are rearranged whole. Other columns stay in ``rearranged``, those whose names
it adds are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.common import table

#: A unit of a text, and the markers of prefix, suffix and middle.
UNIT = "[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: The delimiter, the character that leads an escape, and the escapes of the two.
MARK, LEAD = "\x01", "\x02"
MARK_ESCAPED, LEAD_ESCAPED = LEAD + "m", LEAD + "l"
SEED, PLAIN_PERCENT, SPM_PERCENT = 42, 50, 80


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(LEAD), F.lit(LEAD_ESCAPED)), F.lit(MARK), F.lit(MARK_ESCAPED))


def unescaped(part: Column) -> Column:
    """A part of a marked text as it was: without delimiters, escapes undone."""
    bare = F.replace(part, F.lit(MARK), F.lit(""))
    return F.replace(F.replace(bare, F.lit(MARK_ESCAPED), F.lit(MARK)), F.lit(LEAD_ESCAPED), F.lit(LEAD))


def marked(text: Column) -> Column:
    """The escaped text with the delimiter behind every unit."""
    return F.regexp_replace(escaped(text), UNIT, "$0" + MARK)


def units(marked_text: Column) -> Column:
    return (F.length(marked_text) - F.length(F.replace(marked_text, F.lit(MARK), F.lit("")))).cast("long")


def before(marked_text: Column, rank: Column) -> Column:
    """The first ``rank`` units, with delimiters between."""
    return F.call_function("substring_index", marked_text, F.lit(MARK), rank.cast("int"))


def behind(marked_text: Column, count: Column) -> Column:
    """What stands behind the last ``count`` delimiters."""
    return F.call_function("substring_index", marked_text, F.lit(MARK), (-count).cast("int"))


def number(digest: Column, group: int) -> Column:
    """A group of eight hexadecimal digits as a number."""
    return F.conv(F.substring(digest, 8 * group + 1, 8), 16, 10).cast("long")


def has_marker(text: Column) -> Column:
    return text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)


def rearranged(docs: DataFrame, seed: int = SEED, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """``docs`` with ``n`` (units), ``form`` (plain, psm or spm), ``prefix``, ``middle``, ``suffix`` (null if plain) and
    ``output``.

    Of the texts that can be rearranged ``plain_percent`` of a hundred stay plain, and of the others ``spm_percent`` of a
    hundred have the suffix first; ``seed`` deals them out.
    """
    added = ("n", "form", "prefix", "middle", "suffix", "output")
    names = [c for c in docs.columns if c not in added]
    keep = [F.col(f"`{c}`").alias(f"_in_{i}") for i, c in enumerate(names)]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    # A step for each value that several others read, so that none is computed twice.
    d = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_text"), digest.alias("_digest"))
    d = d.withColumns({"_marked": marked(F.col("_text")), **{f"_h{i + 1}": number(F.col("_digest"), i) for i in range(4)}})
    d = d.withColumn("n", units(F.col("_marked")))
    places = F.col("n") + 1
    a, b = F.col("_h1") % places, F.col("_h2") % places
    plain = (F.col("_text") == "") | has_marker(F.col("_text")) | (F.col("_h3") % 100 >= plain_percent)
    form = F.when(plain, "plain").when(F.col("_h4") % 100 < spm_percent, "spm").otherwise("psm")
    d = d.withColumns({"form": form, "_low": F.least(a, b), "_high": F.greatest(a, b)})
    m, cut = F.col("_marked"), F.col("form") != "plain"
    d = d.withColumns(
        {
            "prefix": F.when(cut, unescaped(before(m, F.col("_low")))),
            "middle": F.when(cut, unescaped(behind(before(m, F.col("_high")), F.col("_high") - F.col("_low")))),
            # The last unit has a delimiter behind it too.
            "suffix": F.when(cut, unescaped(behind(m, F.col("n") - F.col("_high") + 1))),
        }
    )
    output = (
        F.when(~cut, F.col("_text"))
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle"))
        .otherwise(F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle"))
    )
    return d.select(*[F.col(f"_in_{i}").alias(c) for i, c in enumerate(names)], "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    part = lambda x, mark, i: F.substring_index(x, mark, i)
    head = F.substring(output, len(PREFIX) + 1, 1 << 30)
    middle = part(output, MIDDLE, -1)
    first = F.when(form == "psm", part(head, SUFFIX, 1)).otherwise(part(part(output, PREFIX, -1), MIDDLE, 1))
    last = F.when(form == "psm", part(part(output, SUFFIX, -1), MIDDLE, 1)).otherwise(part(head, PREFIX, 1))
    return F.when(form == "plain", output).otherwise(F.concat(first, middle, last))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rearranged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    return d.select(
        "doc_id", "n", "form",
        F.length("prefix").cast("long").alias("prefix_chars"),
        F.length("middle").cast("long").alias("middle_chars"),
        digest(F.col("output")).alias("output_sha256"),
        digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


OP13_SQL = r"""WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS g,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents),
h AS (
  SELECT doc_id, t, u, len(u) AS n, ('0x' || substr(g, 1, 8))::BIGINT % (len(u) + 1) AS a, ('0x' || substr(g, 9, 8))::BIGINT % (len(u) + 1) AS b,
         ('0x' || substr(g, 17, 8))::BIGINT AS h3, ('0x' || substr(g, 25, 8))::BIGINT AS h4
  FROM d),
f AS (
  SELECT *, least(a, b) AS low, greatest(a, b) AS high,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM h),
p AS (
  SELECT *, coalesce(array_to_string(u[1:low], ''), '') AS prefix, coalesce(array_to_string(u[low + 1:high], ''), '') AS middle, coalesce(array_to_string(u[high + 1:n], ''), '') AS suffix
  FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p"""
