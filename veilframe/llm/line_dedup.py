"""Line dedup by distinct-site spread.

A line (blanks at its ends do not count) that stands on many distinct sites is
boilerplate. (line, site) pairs are made distinct under an exchange on both, so neither a
line nor a site that holds a third of all rows is one task's work. Each task then sketches the
sites of its lines (HyperLogLog), and sketches, not rows, meet by line. Lines whose estimate
lies near the threshold get an exact distinct count. Boilerplate stays in the document
of the smallest id that holds it and goes from all others.

Built-in functions only. Texts themselves are shuffled once, to meet the lines that they lose.

Defined results: a null text stays null and has no lines; a null site is a site of
its own; a line without a word is never boilerplate (nor one of fewer than ``min_words``
words, if more are asked for); a row of null
id keeps its lines and owns none; of repeated ids all rows are treated alike; an
empty table gives an empty result; other columns pass through, but for one named like
an output column, which the output takes the place of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import common

#: Distinct sites from which on a line is boilerplate.
SPREAD = 8
MIN_WORDS = 1
#: log2 of a sketch's registers: a standard error of 1.04 / sqrt(4096) = 1.6 %.
LG_K = 12
#: Estimates within this share of the threshold are counted exactly (over 15 standard errors).
NEAR = 0.25

_BLANKS = " \t\x0b\x0c\r"
#: So many words and one more; anchored and possessive, so a line of one endless word costs one pass.
_WORDS = r"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){%d}[^\x20\x09-\x0D]"


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(_BLANKS)))


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, site hash, line hash) of the lines that may be boilerplate."""
    return (
        docs.where(F.col("doc_id").isNotNull())
        .select("doc_id", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull()).alias("s"), F.explode(F.split("text", "\n")).alias("x"))
        .where(F.col("x").rlike(_WORDS % (min_words - 1)))
        .select("doc_id", "s", line_hash(F.col("x")).alias("h"))
    )


def boilerplate(docs: DataFrame, spread: int = SPREAD, min_words: int = MIN_WORDS) -> DataFrame:
    """(h, owner): hash of each boilerplate line and the smallest id that holds it."""
    lines = _lines(docs.select("doc_id", "source", "text"), min_words)
    pairs = common.cut(lines.groupBy("h", "s").agg(F.min("doc_id").alias("owner")))
    # On one site only (nearly all lines): never boilerplate, so no sketch is made. Longs alone, hence hash aggregates that combine in each task.
    shared = common.cut(
        pairs.groupBy("h")
        .agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.min("owner").alias("owner"))
        .where("lo <> hi" if spread > 1 else "true")
        .select("h", "owner")
    )
    wide = common.cut(common.salted_join(pairs.select("h", "s"), shared.select("h"), "h", ["s"], "left_semi"))
    sketched = common.cut(sketches(wide))
    low, high = spread * (1 - NEAR), spread * (1 + NEAR)
    sure = sketched.where(F.col("n") > high).select("h")
    near = sketched.where(F.col("n").between(low, high)).select("h")
    exact = (
        common.salted_join(wide, near, "h", ["s"], "left_semi")  # its rows are distinct
        .groupBy("h")
        .agg(F.count("s").alias("n"))
        .where(F.col("n") >= spread)
        .select("h")
    )
    found = common.cut(shared.join(sure.unionByName(exact), "h"))
    common.discard(pairs, shared, wide, sketched)
    return found


def sketches(wide: DataFrame) -> DataFrame:
    """(h, n): estimated sites of each line of a table (h, s); each task sketches what it reads, and sketches merge by line."""
    return wide.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("s", LG_K)).alias("n"))


def dedup_lines(docs: DataFrame, spread: int = SPREAD, prefix: str = "", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``text`` rid of boilerplate, and ``n_lines``, ``n_removed`` behind ``prefix``."""
    found = boilerplate(docs, spread, min_words)
    lines = _lines(docs.select("doc_id", "source", "text"), min_words).select("doc_id", "h")
    small = found.limit(common.FEW + 1).count() <= common.FEW
    if small:
        met = lines.join(F.broadcast(found), "h")
    else:
        lines = common.cut(lines)
        met = common.salted_join(lines, found, "h", ["doc_id"])
    losses = common.cut(met.where(F.col("doc_id") != F.col("owner")).groupBy("doc_id").agg(F.collect_set("h").alias("__lost")))
    lost, key = common.fresh(docs, "lost", "key")
    losses = losses.select(F.col("doc_id").alias(key), F.col("__lost").alias(lost)).hint("merge")  # alike at every size
    joined = docs.join(losses, docs["doc_id"] == losses[key], "left").drop(key)
    parts = F.split("text", "\n")
    kept = F.filter(parts, lambda x: ~(F.array_contains(F.col(lost), line_hash(x)) & x.rlike(_WORDS % (min_words - 1))))
    has = F.col(lost).isNotNull()
    return joined.withColumns(
        {
            f"{prefix}n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long"),
            f"{prefix}n_removed": F.when(has, F.size(parts) - F.size(kept)).otherwise(0).cast("long"),
            "text": F.when(has, F.array_join(kept, "\n")).otherwise(F.col("text")),
        }
    ).drop(lost)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text after line dedup and how many lines it had and lost."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return dedup_lines(docs).select("doc_id", "text", "n_lines", "n_removed")


ORACLE = rf"""
WITH l AS (
  SELECT doc_id, coalesce('+' || source, '-') AS s, i, x, trim(x, {"' ' || chr(9) || chr(11) || chr(12) || chr(13)"}) AS k,
         len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) >= {MIN_WORDS} AS able
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS x,
               generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
), b AS (
  SELECT k, min(doc_id) AS owner FROM l WHERE able GROUP BY k HAVING count(DISTINCT s) >= {SPREAD}
), r AS (
  SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE able AND b.k IS NOT NULL AND b.owner <> doc_id) AS n_removed,
         coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE NOT (able AND b.k IS NOT NULL AND b.owner <> doc_id)), '') AS text
  FROM l LEFT JOIN b USING (k) GROUP BY 1
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE r.text END AS text,
       CAST(coalesce(r.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(r.n_removed, 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN r USING (doc_id)
"""
