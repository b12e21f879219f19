"""Font tables as relations: decoding of byte codes, /Differences and widths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions import encodings

DEFAULT_WIDTH = 600


def encoding_table(spark) -> DataFrame:
    """encoding, code, base: a few hundred rows, whatever the data."""
    rows = [(n, b, ch) for n in encodings.NAMES for b, ch in encodings.table(n).items()]
    return spark.createDataFrame(rows, "encoding string, code int, base string")


def decode(codes: DataFrame, to_unicode: DataFrame, differences: DataFrame, widths: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``ch`` and ``width`` of each code: ToUnicode first, then differences, then the base encoding, else U+FFFD.

    ``keys`` name a font (document, page, name ...) in ``codes`` and in the three tables; without them all codes
    are of one font. The tables of a font become one row a code first, so codes are joined once,
    and that join may be a broadcast or not, as their size is. The encodings are of fixed size.
    """
    keys = [*(keys or []), "code"]
    parts = []
    for df, column, name in ((to_unicode, "ch", "__u"), (differences, "ch", "__d"), (widths, "width", "__w")):
        none = [F.lit(None).cast("int" if n == "__w" else "string").alias(n) for n in ("__u", "__d", "__w") if n != name]
        parts.append(df.select(*keys, F.col(column).alias(name), *none))
    own = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("__u", "__d", "__w")])
    out = codes.join(own, keys, "left").join(F.broadcast(encoding_table(codes.sparkSession)), ["encoding", "code"], "left")
    return out.withColumns({"ch": F.coalesce("__u", "__d", "base", F.lit("�")), "width": F.coalesce("__w", F.lit(DEFAULT_WIDTH))}).drop("__u", "__d", "base", "__w")


def differences(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys, code, name of a /Differences array given as rows with ``number`` or ``name``.

    A number sets the code of the next name; each name takes the next code. Names before any number have none.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    n = F.row_number().over(w)
    r = rows.withColumn("__n", n)
    base, at = F.last("number", ignorenulls=True).over(w), F.last(F.when(F.col("number").isNotNull(), F.col("__n")), ignorenulls=True).over(w)
    return r.withColumn("code", (base + F.col("__n") - at - 1).cast("long")).where("name is not null and code is not null").select(*keys, "code", "name")
