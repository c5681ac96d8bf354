"""The same run over a folder that texts keep arriving in (each document is on its own, so no state is kept)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from attestra.operators import emit
from attestra.plans import pipeline


def watch(spark: SparkSession, folder: str, records: DataFrame, out: str, checkpoint: str, table: DataFrame | None = None) -> StreamingQuery:
    """Traces of new *.txt files as JSON under out, until what is there is read."""
    files = spark.readStream.option("pathGlobFilter", "*.txt").option("wholetext", "true").text(folder)
    docs = files.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", "").alias("documento_id"), F.regexp_replace("value", "\r\n?", "\n").alias("texto"))

    def each(batch: DataFrame, number: int) -> None:
        emit.write_trace(pipeline.run(batch, records, table), f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
