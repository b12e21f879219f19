"""Object graphs: reachability, inheritance down a page tree, latest revisions, clean-up."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Deepest page tree that is followed.
MAX_DEPTH = 64


def _cut(df: DataFrame) -> DataFrame:
    """``df`` as a table in the session's spark.checkpoint.dir (where it is unset, under a local master only, a local folder); deleted when the driver ends."""
    spark = df.sparkSession
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set, and a folder of this machine is none that executors see")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="veilframe-"))
    path = f"{jsc.getCheckpointDir().get()}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    return spark.read.schema(df.schema).parquet(path)


def reachable(edges: DataFrame, roots: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``keys`` and ``node`` of all nodes reachable from ``roots``, themselves included; edges have (keys, src, dst).

    A frontier at a time; nothing but whether one is left comes to the driver.
    """
    keys = keys or []
    seen = _cut(roots.select(*keys, "node").distinct())
    frontier = seen
    while not frontier.isEmpty():
        step = frontier.withColumnRenamed("node", "src").join(edges, [*keys, "src"]).select(*keys, F.col("dst").alias("node")).distinct()
        frontier = _cut(step.join(seen, [*keys, "node"], "left_anti"))
        seen = _cut(seen.unionByName(frontier))
    return seen


def inherit(nodes: DataFrame, attributes: list[str]) -> DataFrame:
    """Page-tree nodes (node, parent, attributes) with ``depth``, each attribute its own or the nearest ancestor's, and ``error``.

    Nodes that no root leads to within ``MAX_DEPTH`` levels, as they lie deeper or on a cycle, are
    rows with ``error`` Corrupt, a null depth and their own attributes.
    """
    nodes.createOrReplaceTempView("__tree")
    cols = ", ".join(attributes)
    down = ", ".join(f"coalesce(n.{a}, t.{a})" for a in attributes)
    tree = nodes.sparkSession.sql(f"""
        WITH RECURSIVE t(node, parent, depth, {cols}) MAX RECURSION LEVEL {MAX_DEPTH + 1} AS (
          SELECT node, parent, 0, {cols} FROM __tree WHERE parent IS NULL
          UNION ALL
          SELECT n.node, n.parent, t.depth + 1, {down} FROM __tree n JOIN t ON n.parent = t.node WHERE t.depth < {MAX_DEPTH}
        ) SELECT * FROM t""").withColumn("error", F.lit(None).cast("string"))
    lost = nodes.join(tree.select("node"), "node", "left_anti").select("node", "parent", F.lit(None).cast("int").alias("depth"), *attributes, F.lit("Corrupt").alias("error"))
    return tree.unionByName(lost)


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key: an aggregation, so tasks send one row per key."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    top = F.max(F.struct(*order, *rest)).alias("__top")
    return rows.groupBy(*keys).agg(top).select(*keys, *[F.col(f"__top.{c}").alias(c) for c in [*order, *rest]])


def chunks(objects: DataFrame, keys: list[str], order: list[str], size: int = 100) -> DataFrame:
    """``chunk`` and ``slot`` of each object in its document's object streams."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return objects.withColumn("__n", n).withColumns({"chunk": F.floor(F.col("__n") / size).cast("long"), "slot": (F.col("__n") % size).cast("long")}).drop("__n")


def offsets(objects: DataFrame, keys: list[str], order: list[str], length: Column, start: int) -> DataFrame:
    """``offset`` of each object in a file whose header has ``start`` bytes."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return objects.withColumn("offset", (F.lit(start) + F.coalesce(F.sum(length).over(w), F.lit(0))).cast("long"))
