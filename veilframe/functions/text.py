"""Text normalisation and formatting as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space, with Unicode rules.
SPACE = r"(?U)\s"


def let(value: Column, body) -> Column:
    """``body`` of ``value``, with value computed once."""
    return F.transform(F.array(value), body)[0]


def normalise(text: Column) -> Column:
    """Lower case, each run of white space one space; ends are kept."""
    return F.lower(F.regexp_replace(text, SPACE + "+", " "))


def normalise_query(query: str) -> str:
    """A query as the index has it: lower case by character, runs of white space one space, trimmed."""
    low = "".join(c.lower() for c in query)
    return re.sub(r"[\t-\r \x85   -     　]+", " ", low).strip(" ")


def quote(query: str) -> str:
    """A Java pattern for the very characters of ``query``."""
    return re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", query)


def number(value: Column, places: int = 6) -> Column:
    """A decimal number without trailing zeros, as content streams have it."""
    fixed = F.format_string(f"%.{places}f", value.cast("double"))
    short = F.regexp_replace(F.regexp_replace(fixed, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(short.isin("-0", ""), "0").otherwise(short)


def literal(text: Column) -> Column:
    """A text between parentheses with its escapes."""
    return F.concat(F.lit("("), F.regexp_replace(text, r"([\\()])", r"\\$1"), F.lit(")"))
