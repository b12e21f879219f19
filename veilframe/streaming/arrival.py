"""Files as they arrive: parse each new PDF once, append its pages to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from veilframe.sources import pdf

_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """path, content of files as they appear; the source's own log sees to it that each comes once."""
    return spark.readStream.format("binaryFile").schema(_SCHEMA).option("pathGlobFilter", "*.pdf").option("maxFilesPerTrigger", per_trigger).load(folder).select("path", "content")


def pages_to(spark: SparkSession, folder: str, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends the pages of arriving files to Parquet; ``once`` takes what is there and ends. Stateless: nothing waits for late data."""
    writer = pdf.pages(arriving(spark, folder)).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
