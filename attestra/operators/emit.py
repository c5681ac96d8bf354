"""Output: documents as JSON, submission cells, traces, and their files."""

from __future__ import annotations

import os
import uuid
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.plans.schemas import TRACE_COLUMNS


def documents(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """documento_id and citacoes, an array by start, for every document: also those without a citation.

    resolucao stands with real citations only, and both it and confianca are left out of the JSON where they are null.
    """
    resolved = F.when(F.col("classificacao") == "real", F.struct(F.col("id_canonico").alias("id_canonico")))
    item = F.struct("inicio", "fim", "trecho", "tipo", "classificacao", resolved.alias("resolucao"), "confianca")
    grouped = decided.groupBy(F.col("documento_id").alias("_id")).agg(F.array_sort(F.collect_list(item)).alias("citacoes"))
    out = docs.select("documento_id").join(grouped, F.col("documento_id") == F.col("_id"), "left")
    none = F.array().cast(grouped.schema["citacoes"].dataType)
    return out.select("documento_id", F.coalesce("citacoes", none).alias("citacoes"))


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select("documento_id", F.to_json(F.struct("documento_id", "citacoes")).alias("json"))


def write_documents(rows: DataFrame, folder: str) -> None:
    """One JSON line for each document, in place of what the folder held."""
    as_json(rows).select(F.col("json").alias("value")).write.mode("overwrite").text(folder)


def cell(citations: Column) -> Column:
    """start,end,class,id,confidence of each citation, joined by |; - for none and for what is null.

    Confidences have four places, rounded half to even.
    """
    places = lambda c: F.bround(c, 4).cast("decimal(6,4)").cast("string")
    own = lambda c: F.coalesce(c["resolucao"]["id_canonico"].cast("string"), F.lit("-"))
    text = F.transform(citations, lambda c: F.concat_ws(",", c["inicio"].cast("string"), c["fim"].cast("string"), c["classificacao"], own(c), F.coalesce(places(c["confianca"]), F.lit("-"))))
    return F.when(F.size(citations) == 0, "-").otherwise(F.array_join(text, "|"))


def submission(rows: DataFrame) -> DataFrame:
    """documento_id and citacoes as a cell."""
    return rows.select("documento_id", cell(F.col("citacoes")).alias("citacoes"))


def from_gold(gold: DataFrame) -> DataFrame:
    """The gold itself as solution cells by document and level: start,end,class,ids."""
    ids = F.when(F.size("ids") == 0, "-").otherwise(F.array_join("ids", ":"))
    block = F.concat_ws(",", F.col("inicio").cast("string"), F.col("fim").cast("string"), "classificacao", ids)
    rows = gold.groupBy("documento_id", "nivel").agg(F.array_sort(F.collect_list(F.struct("inicio", block.alias("b")))).alias("s"))
    return rows.select("documento_id", "nivel", F.array_join(F.transform("s", lambda x: x["b"]), "|").alias("citacoes"))


def write_submission(rows: DataFrame, folder: str) -> None:
    """CSV files without headers, in order by document from one to the next; one_file() makes them one."""
    rows.select("documento_id", "citacoes").orderBy("documento_id").write.mode("overwrite").csv(folder)


def one_file(spark: SparkSession, folder: str, path: str, header: str = "documento_id,citacoes") -> None:
    """The part files of a folder behind a header, copied as they are, so no task holds all rows."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path
    source, target = at(folder), at(path)
    files, out = source.getFileSystem(conf), target.getFileSystem(conf).create(target, True)
    try:
        out.write(bytearray(f"{header}\n", "utf-8"))
        parts = sorted(str(f.getPath()) for f in files.listStatus(source) if f.getPath().getName().startswith("part-"))
        for part in parts:
            stream = files.open(at(part))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 16, False)
            stream.close()
    finally:
        out.close()


def write_document_files(rows: DataFrame, folder: str) -> None:
    """One JSON file for each document, named by its id, in a mounted folder that driver and executors share.

    A file is written under another name and then renamed, so a task that runs twice leaves whole files.
    """
    made = as_json(rows)

    def write(batches):
        where = folder.removeprefix("file://")
        os.makedirs(where, exist_ok=True)
        for batch in batches:
            for row in batch.to_pylist():
                path = os.path.join(where, quote(row["documento_id"], safe=" ") + ".json")
                with open(f"{path}.{uuid.uuid4().hex}", "w", encoding="utf-8") as f:
                    f.write(row["json"])
                os.replace(f.name, path)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    made.mapInArrow(write, "n bigint").agg({"n": "sum"}).collect()


def trace(decided: DataFrame) -> DataFrame:
    return decided.select(*TRACE_COLUMNS)


def write_trace(decided: DataFrame, folder: str) -> None:
    """JSON lines, by start and end within a document, nulls included."""
    rows = trace(decided).repartition("documento_id").sortWithinPartitions("documento_id", "inicio", "fim")
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(folder)
