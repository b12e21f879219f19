"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and U+0009 to U+000D.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *bases: str) -> list[str]:
    """Column names close to ``bases`` that ``df`` does not use (case-insensitively)."""
    used = {c.lower() for c in df.columns}
    out = []
    for base in bases:
        name, k = f"__{base}", 0
        while name.lower() in used:
            name, k = f"__{base}_{k}", k + 1
        used.add(name.lower())
        out.append(name)
    return out


def bucket(doc_id: Column, mod: int) -> Column:
    """crc32(doc_id as text) mod ``mod``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(mod)


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let no Arrow batch of this session hold over ``rows`` rows: they carry whole texts, and a worker keeps one or two batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it is unset, a local folder under a local master (tests), else an error."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        set_dir = spark.conf.get("spark.checkpoint.dir", None)
        if not set_dir and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set, and a folder of this machine is none that executors see")
        spark.sparkContext.setCheckpointDir(set_dir or tempfile.mkdtemp(prefix="veilframe-"))
    return jsc.getCheckpointDir().get()


def _hadoop(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def cut(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder, read again: its lineage ends there. Deleted when the driver ends, or by ``discard``."""
    spark = df.sparkSession
    path = path or f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    system, there = _hadoop(spark, path)
    system.deleteOnExit(there)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut = path
    return out


def discard(*cuts: DataFrame) -> None:
    """Delete tables that ``cut`` wrote and nothing will read again."""
    for df in cuts:
        system, there = _hadoop(df.sparkSession, df._cut)
        system.delete(there, True)


#: At most so many keys are dealt to several tasks, and none of so few rows.
SHARE, LEAST = 4096, 256


def salted_join(left: DataFrame, right: DataFrame, on: str, by: list[str], how: str = "inner", counted: DataFrame | None = None) -> DataFrame:
    """``left`` joined with ``right`` (a row a key, or few) on the long column ``on``, whatever share of ``left`` a key holds.

    Rows of the ``SHARE`` most frequent keys (of ``counted``, a table; ``left`` unless given) are dealt
    to several tasks by a hash of ``by``, and their rows of ``right`` go to each. So no key that is
    left whole has over 1 / ``SHARE`` of the rows, and what is broadcast is bounded.
    """
    counts = (left if counted is None else counted).groupBy(on).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > LEAST).where(F.col(on).isNotNull())
    hot = counts.orderBy(F.desc("__n"), on).limit(SHARE).collect()
    if not hot:
        return left.join(right, on, how)
    limit = max(LEAST, sum(r[1] for r in hot) // SHARE)  # twice ``SHARE`` parts at most
    parts = F.broadcast(left.sparkSession.createDataFrame([(r[0], -(-r[1] // limit)) for r in hot], f"`{on}` long, __parts int"))
    dealt = left.join(parts, on, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(*by), "__parts").cast("int"), F.lit(0))).drop("__parts")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))
    copies = right.join(parts, on, "left").withColumn("__salt", every).drop("__parts")
    return dealt.join(copies, [on, "__salt"], how).drop("__salt")


#: So many rows of a few longs are broadcast at most (some tens of MB); beyond that they are shuffled.
FEW = 300_000


def few(table: DataFrame) -> DataFrame:
    """A table, to be broadcast if it has at most ``FEW`` rows."""
    return F.broadcast(table) if table.limit(FEW + 1).count() <= FEW else table


def sample(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, text, label) of at most ``per_class`` documents of each label value 0 and 1.

    Only rows whose crc32(doc_id as text) mod 5 is not 0 take part. The bound is
    on what a model is fitted to, never on what is scored; the rows are those of
    smallest hash of the id, whatever the partitioning. A document that is labelled
    both ways, or whose label or id is null, is no example; of a repeated id the smallest
    text stands for all, and null is the empty text.
    """
    ok = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (bucket(F.col("doc_id"), 5) != 0))
        .groupBy("doc_id")
        .agg(F.min(label).alias("__lo"), F.max(label).alias("__hi"))
        .where("__lo = __hi")
        .select("doc_id", F.col("__lo").cast("int").alias("label"), F.xxhash64("doc_id").alias("__h"))
    )
    picked = None
    for v in (0, 1):
        part = ok.where(F.col("label") == v).orderBy("__h", "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    ids = [(r[0], r[1]) for r in picked.select("doc_id", "label").collect()]  # 2 * per_class rows at most
    chosen = spark.createDataFrame(ids, "doc_id bigint, label int")
    found = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return found.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


#: A document of more characters is no example: with the bound on examples, a bound on what reaches the driver.
EXAMPLE_CHARS = 1_000_000


def labelled_sample(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> list:
    """The rows of ``sample`` in the order of their ids, whole texts of at most ``EXAMPLE_CHARS`` characters."""
    return sample(spark, docs, labels, label, per_class).where(F.length("text") <= EXAMPLE_CHARS).orderBy("doc_id").collect()
