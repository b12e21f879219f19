"""Connected components of a graph of ids, by contraction.

Each round hooks every vertex to its smallest neighbour, shortens the pointers and
keeps the edges between different roots only. A vertex may hold any share of the edges:
``min`` is aggregated in each task first, and joins deal hot vertices to several tasks.
Nothing but counts, and the hot vertices of a join (a bounded number), reaches the
driver; lineage is cut in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import cut, discard, salted_join


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b: long); component is the smallest id reachable.

    Null ends and loops are ignored, repeated edges count once, no edges give no rows.
    """
    live = cut(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    labels = cut(live.select(F.col("a").alias("id")).union(live.select("b")).distinct().withColumn("component", F.col("id")))
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = cut(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("p")))
        for _ in range(2):  # pointers to pointers
            up = hook.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            hook, old = cut(salted_join(hook, up, "p", ["v"]).select("v", F.col("pp").alias("p"))), hook
            discard(old)
        point = hook.select(F.col("v").alias("component"), "p")
        old, labels = labels, cut(salted_join(labels, point, "component", ["id"], "left").select("id", F.coalesce("p", "component").alias("component")))
        a, b = (hook.select(F.col("v").alias(c), F.col("p").alias("p" + c)) for c in "ab")
        half = cut(salted_join(live, a, "a", ["b"]))
        ends = salted_join(half, b, "b", ["a"])
        live, gone = cut(ends.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()), live
        discard(old, half, gone, hook)
    discard(live)
    return labels
