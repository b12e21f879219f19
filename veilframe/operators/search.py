"""Case-insensitive, white-space-tolerant search over pages, with geometry.

An index entry is a page's display text, lower-cased and with runs of white space made
one space; lines are joined by a line break, so a match may cross lines but never
pages. Matches do not overlap and are found from left to right by splitting at the
query, which is a scan inside the row: no shuffle, whatever the number of pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.text import SPACE, let, normalise, normalise_query, quote
from veilframe.operators import textlayer


def index(pages: DataFrame) -> DataFrame:
    """doc_id, page_index, lines, normalised text."""
    return pages.select("doc_id", "page_index", "lines", normalise(F.array_join("lines", "\n")).alias("norm"))


def count(index: DataFrame, query: str) -> DataFrame:
    """doc_id, page_index, n_matches of the pages that have one."""
    q = normalise_query(query)
    if not q:
        return index.select("doc_id", "page_index", F.lit(0).cast("long").alias("n_matches")).where(F.lit(False))
    n = F.size(F.split("norm", quote(q), -1)) - 1
    return index.select("doc_id", "page_index", n.cast("long").alias("n_matches")).where("n_matches > 0")


def _running(steps: Column, lead: int = 0) -> Column:
    """Sum of an array (``at``), and for each element the sum up to it, less ``lead`` (``found``)."""
    return F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("found")),
        lambda s, x: F.struct((s["at"] + x).alias("at"), F.array_append(s["found"], s["at"] + x - lead).alias("found")),
    )


#: Matches whose places are summed up in one go: appending copies an array, so it is done to short ones.
RUN = 64


def starts(norm: Column, query: str) -> Column:
    """Positions of the matches in a normalised text: running sums of what lies between them, run by run."""
    size = len(query)

    def located(parts: Column) -> Column:
        steps = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda x: F.length(x) + size)
        last = ((F.size(parts) - 2) / RUN).cast("int")
        return let(steps, lambda xs: let(F.transform(F.sequence(F.lit(0), last), lambda k: _running(F.slice(xs, k * RUN + 1, F.lit(RUN)), size)), joined))

    def joined(runs: Column) -> Column:
        before = let(_running(F.transform(runs, lambda r: r["at"])), lambda s: F.transform(runs, lambda r, k: F.get(s["found"], k) - r["at"]))
        return F.flatten(F.zip_with(runs, before, lambda r, at: F.transform(r["found"], lambda x: x + at)))

    return let(F.split(norm, quote(query), -1), located)


def positions(index: DataFrame, query: str) -> DataFrame:
    """doc_id, page_index, match_index, start (in the normalised text), and the page's lines."""
    q = normalise_query(query)
    if not q:
        return index.select("doc_id", "page_index", F.lit(0).alias("match_index"), F.lit(0).alias("start"), "lines").where(F.lit(False))
    # Parts of the split, exploded, with a running sum of lengths kept beside them.
    hit = index.where(F.contains("norm", F.lit(q)))
    return hit.select("doc_id", "page_index", "lines", F.posexplode(starts(F.col("norm"), q)).alias("match_index", "start"))


def multi(index: DataFrame, queries: list[str]) -> DataFrame:
    """query, doc_id, page_index, n_matches for each of several queries (a stated, small list)."""
    # One pass over the index: a page is normalised once, whatever the number of queries.
    asked = [(q, n) for q in queries if (n := normalise_query(q))]
    if not asked:
        return index.select(F.lit("").alias("query"), "doc_id", "page_index", F.lit(0).cast("long").alias("n_matches")).where(F.lit(False))
    found = [F.struct(F.lit(q).alias("query"), (F.size(F.split("norm", quote(n), -1)) - 1).cast("long").alias("n")) for q, n in asked]
    hits = index.select("doc_id", "page_index", F.explode(F.filter(F.array(*found), lambda x: x["n"] > 0)).alias("hit"))
    return hits.select("hit.query", "doc_id", "page_index", F.col("hit.n").alias("n_matches"))


def kept(lines: Column) -> Column:
    """For each character of a page's normalised text, where it stands in the display text."""
    chars = F.split(F.array_join(lines, "\n"), "")
    blank = lambda c: c.rlike(SPACE)
    return let(
        F.transform(chars, lambda c: F.struct(blank(c).alias("b"))),
        lambda b: F.filter(F.sequence(F.lit(0), F.size(b) - 1), lambda i: ~(b[i]["b"] & (i > 0) & b[F.greatest(i - 1, F.lit(0))]["b"])),
    )


def quads(index: DataFrame, query: str | list[str]) -> DataFrame:
    """A row per match and line it touches: columns of the line, and the merged box of its glyphs.

    Of several queries the matches are numbered query by query; a page is read once for all.
    """
    asked = [q for q in map(normalise_query, [query] if isinstance(query, str) else query) if q]
    any_hit = F.lit(False)
    for q in asked:
        any_hit = any_hit | F.contains("norm", F.lit(q))

    def span(n: int):
        return lambda s: F.struct(F.get("kept", s).alias("a"), F.get("kept", s + (n - 1)).alias("b"))

    spans = [F.transform(starts(F.col("norm"), q), span(len(q))) for q in asked]
    place = index.where(any_hit).select(
        "doc_id", "page_index", "norm", kept(F.col("lines")).alias("kept"), textlayer.starts(F.col("lines")).alias("at"), F.transform("lines", lambda x: F.length(x)).alias("size"),
    )
    none = F.expr("cast(array() as array<struct<a:int,b:int>>)")
    # All of a page's matches at once, so the page's arrays are not copied for each; of its lines only those a match touches become rows.
    ends = place.select("doc_id", "page_index", "at", "size", F.posexplode(F.concat(*spans) if spans else none).alias("match_index", "span"))
    cut = F.transform(
        F.arrays_zip("at", "size"),
        lambda x, i: F.struct(
            i.alias("line_no"), F.greatest(F.col("span.a") - x["at"], F.lit(0)).alias("first"), F.least(F.col("span.b") - x["at"], x["size"] - 1).alias("last")
        ),
    )
    rows = ends.select("doc_id", "page_index", "match_index", F.explode(F.filter(cut, lambda x: x["first"] <= x["last"])).alias("x")).select("doc_id", "page_index", "match_index", "x.*")
    box = textlayer.run_box(F.col("line_no"), F.col("first"), F.col("last"))
    return rows.select(
        "doc_id", "page_index", F.col("match_index").cast("long").alias("match_index"), F.col("line_no").cast("long").alias("line_no"),
        F.col("first").cast("long").alias("first_col"), F.col("last").cast("long").alias("last_col"),
        *[c.cast("long").alias(n) for n, c in zip(("x0", "y0", "x1", "y1"), (box.x0, box.y0, box.x1, box.y1))],
    )


def matches_to_targets(quads: DataFrame) -> DataFrame:
    """Each match as one quad-group target: doc_id, page_index, target_index, bounds and its quads."""
    box = F.struct("x0", "y0", "x1", "y1")
    return quads.groupBy("doc_id", "page_index", F.col("match_index").alias("target_index")).agg(
        F.lit("quadGroup").alias("kind"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.sort_array(F.collect_list(box)).alias("quads")
    )
