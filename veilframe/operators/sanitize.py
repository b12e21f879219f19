"""Document clean-up: metadata, attachments, hidden layers, and their counterpart in web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What html() takes out, in this order. Shared by Java's and RE2's dialects.
HTML_PATTERNS = (
    r"(?is)<!--.*?-->",
    r"(?is)<script\b.*?</script\s*>",
    r"(?is)<style\b.*?</style\s*>",
    r"(?is)<meta\b[^>]*>",
    r"(?is)<[a-z]+\b[^>]*display\s*:\s*none[^>]*>[^<]*</[a-z]+\s*>",
)
#: Personal data and secrets, with what takes their place. Shared by both dialects.
PII_PATTERNS = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]"),
    (r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", "[IP]"),
    (r'token = "[0-9A-Za-z]+"', 'token = "[SECRET]"'),
)


#: The first of them for Java's backtracking engine: tried at the start of a run only, so an endless word costs one pass.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def _java(pattern: str) -> str:
    return _EMAIL if pattern == PII_PATTERNS[0][0] else pattern


def html(column: Column) -> Column:
    """A page without comments, scripts, styles, meta tags and hidden elements."""
    for p in HTML_PATTERNS:
        column = F.regexp_replace(column, p, "")
    return column


def pii(column: Column) -> Column:
    for p, with_ in PII_PATTERNS:
        column = F.regexp_replace(column, _java(p), with_)
    return column


def pii_count(column: Column) -> Column:
    """Matches of the patterns, each counted in the original text."""
    n = F.lit(0)
    for p, _ in PII_PATTERNS:
        n = n + F.regexp_count(column, F.lit(_java(p)))
    return n


def hidden_layers(layers: DataFrame, config: DataFrame, keys: list[str]) -> DataFrame:
    """Layers (keys, layer, listed_on, listed_off) that ``config`` (keys, base_state) hides.

    The off list, or where the base state is OFF or Unchanged all layers but the on list.
    """
    all_ = layers.join(config, keys)
    off_base = F.coalesce(F.col("base_state").isin("OFF", "Unchanged"), F.lit(False))
    hidden = all_.where(off_base).select(*keys, "layer").exceptAll(all_.where(off_base & F.col("listed_on")).select(*keys, "layer"))
    return hidden.unionByName(all_.where(~off_base & F.col("listed_off")).select(*keys, "layer")).distinct()


def hidden_sections(ops: DataFrame, keys: list[str], order: list[str], opens_hidden: Column, opens: Column, closes: Column) -> DataFrame:
    """``hidden`` of each operation: inside a hidden section, its marks included. Nested sections are followed.

    Sums over a page's operations in order, in rows that may spill: the depth (closes beyond the
    opens count for nothing), and within a depth each close beside its open.
    """
    step = F.when(opens_hidden | opens, 1).when(closes, -1).otherwise(0)
    page = Window.partitionBy(*keys).orderBy(*order)
    before = page.rowsBetween(Window.unboundedPreceding, -1)
    r = ops.withColumns({"__k": F.when(opens_hidden, 2).when(opens, 1).when(closes, -1).otherwise(0), "__s": F.sum(step).over(page)})
    r = r.withColumn("__d", F.col("__s") - F.least(F.lit(0), F.min("__s").over(page)))  # the depth after
    # Of an open, the depth it makes; of a close, the depth it ends (null if there is none to end).
    shallow = F.coalesce(F.lag("__d").over(page), F.lit(0)) == 0
    r = r.withColumn("__level", F.when(F.col("__k") > 0, F.col("__d")).when((F.col("__k") < 0) & ~shallow, F.col("__d") + 1))
    mate = F.lag("__k").over(Window.partitionBy(*keys, "__level").orderBy(*order))
    turn = F.when(F.col("__k") == 2, 1).when((F.col("__k") < 0) & F.col("__level").isNotNull() & (mate == 2), -1).otherwise(0)
    r = r.withColumn("__t", turn)
    inside = F.coalesce(F.sum("__t").over(before), F.lit(0)) > 0
    return r.withColumn("hidden", inside | (F.col("__k") == 2)).select(*keys, *order, *[c for c in ops.columns if c not in keys and c not in order], "hidden")
