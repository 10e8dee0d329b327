"""Line dedup by spread over sites: lines that stand on many distinct sites are boilerplate.

Every line is named by hashes of its trimmed text.  One HyperLogLog sketch of sites per line, merged by Spark's
aggregation, tells how many sites it is on; lines whose estimate is near the threshold are counted exactly.  Each
boilerplate line stays where it stands first in the document of the smallest key, and goes everywhere else.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.operators.scale import each, salted_join
from corpusflow.session import materialize

#: Sites from which on a line is boilerplate.
LEAST_SITES = 10
#: Size of a sketch (its standard error is about 1.04 / 2 ** (LOG_SIZE / 2)), and the share of the threshold on either
#: side within which an estimate is replaced by an exact count: about eight standard errors.
LOG_SIZE, NEAR = 10, 0.25
#: Boilerplate lines (of three numbers each) that are sent to all tasks; more are joined by hash, hot lines salted.
SENT_LINES = 500_000

BLANKS = " \t\x0b\x0c\r"


def lines_of(docs: DataFrame, key: str, text: str, site: str) -> DataFrame:
    """``key, site, row, row_check, code, check, at`` of every line that is not blank."""
    trimmed = F.transform(F.split(text, "\n"), lambda x: F.trim(x, F.lit(BLANKS)))
    named = F.transform(trimmed, lambda x: F.when(x != "", F.struct(F.xxhash64(x).alias("code"), F.hash(x).alias("check"))))
    rows = docs.select(
        F.col(key).alias("key"),
        F.col(site).cast("string").alias("site"),
        F.xxhash64(key, text).alias("row"),
        F.hash(text, key).alias("row_check"),
        named.alias("lines"),
    )
    spread = each(rows, F.col("lines"), "line", ["key", "site", "row", "row_check"], "at")
    return spread.select("key", "site", "row", "row_check", "line.code", "line.check", "at")


def boilerplate(lines: DataFrame, least: int) -> DataFrame:
    """``code, check, holder``: the lines on ``least`` sites or more, and the smallest key that has each.

    Rows without a site, or without a key, do not count towards sites or holders.
    """
    sketches = lines.groupBy("code", "check").agg(F.hll_sketch_agg("site", F.lit(LOG_SIZE)).alias("sketch"), F.min("key").alias("holder"), F.count(F.lit(1)).alias("n"))
    # A line has no more sites than places, so most lines need no estimate.
    told = sketches.filter(F.col("n") >= least).select("code", "check", "holder", F.hll_sketch_estimate("sketch").alias("sites"))
    told = materialize(told.filter(F.col("sites") >= least * (1 - NEAR)), "line-sites")
    far, near = told.filter(F.col("sites") > least * (1 + NEAR)), told.filter(F.col("sites") <= least * (1 + NEAR))
    pairs = lines.select("code", "check", "site").join(near.select("code", "check"), ["code", "check"], "left_semi").distinct()
    exact = pairs.groupBy("code", "check").agg(F.count("site").alias("exact")).filter(F.col("exact") >= least)
    found = far.select("code", "check", "holder").unionByName(near.join(exact, ["code", "check"]).select("code", "check", "holder"))
    return materialize(found, "boilerplate")


def line_dedup(docs: DataFrame, least: int = LEAST_SITES, key: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """All columns of ``docs`` with boilerplate lines taken out of ``text``, and ``n_removed``, their number.

    Lines are compared without blanks around them; blank lines stay.  Texts without boilerplate stay byte for byte;
    null texts stay null.  Rows with a null key hold no line but lose boilerplate like others; a boilerplate line that
    only such rows have goes from all of them.  Rows that are alike in key and text are treated alike.  A column
    ``n_removed`` is replaced.  The work on a text grows with its number of lines, however many of them are equal.
    """
    docs = docs.drop("n_removed")
    lines = lines_of(docs, key, text, site)
    known = boilerplate(lines, least)
    lines = lines.drop("site")
    if known.count() <= SENT_LINES:
        hits = lines.join(F.broadcast(known), ["code", "check"])
    else:
        hits = salted_join(lines, known.withColumnRenamed("check", "known_check"), "code").filter("check = known_check")
    # The places of one boilerplate line in one text; in the holder's text the first of them stays.
    same = hits.groupBy("row", "row_check", "code", "check").agg(F.collect_set("at").alias("places"), F.min("at").alias("first"), F.first("key").alias("key"), F.first("holder").alias("holder"))
    stays = F.col("key").eqNullSafe(F.col("holder")) & F.col("key").isNotNull()
    lost = same.select("row", "row_check", F.when(stays, F.array_remove("places", F.col("first"))).otherwise(F.col("places")).alias("lost"))
    places = lost.groupBy("row", "row_check").agg(F.flatten(F.collect_list("lost")).alias("gone")).filter(F.size("gone") > 0)
    # The row travels as one value, so that none of its columns can clash with the names used here.
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.xxhash64(key, text).alias("row"), F.hash(text, key).alias("row_check"))
    joined = whole.join(places, ["row", "row_check"], "left")
    body = F.col("doc").getField(text)
    # The lines are bound once (as the one element of an array) and then picked by the places that are left.
    left = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    rest = F.transform(F.array(F.split(body, "\n")), lambda lines: F.array_join(F.transform(left(lines), lambda i: F.get(lines, i)), "\n"))[0]
    cut = F.when(F.col("gone").isNull(), body).otherwise(rest)
    columns = [(cut if c == text else F.col("doc").getField(c)).alias(c) for c in docs.columns]
    return joined.select(*columns, F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))


#: The same in SQL, with exact counts for all lines.
SQL = f"""
WITH numbered AS (
  SELECT doc_id, text, source, unnest(range(len(string_split(text, chr(10))))) AS place, unnest(string_split(text, chr(10))) AS line FROM documents
), lines AS (
  SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS plain,
         row_number() OVER (PARTITION BY doc_id, text, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) ORDER BY place) AS turn FROM numbered
), spread AS (
  SELECT plain, min(doc_id) AS holder FROM lines WHERE plain <> '' GROUP BY plain HAVING count(DISTINCT source) >= {LEAST_SITES}
), judged AS (
  SELECT l.*, s.plain IS NOT NULL AND NOT (l.doc_id = s.holder AND l.turn = 1) AS gone FROM lines l LEFT JOIN spread s ON l.plain = s.plain
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '') AS text, count(*) FILTER (gone) AS n_removed FROM judged GROUP BY doc_id
"""
