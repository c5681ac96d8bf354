"""Sources: texts, gold, traces, confidence tables, submissions and fingerprints."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.plans import schemas


def line_ends(text: Column | str) -> Column:
    """The text with \\n for \\r\\n and for \\r."""
    return F.regexp_replace(text, "\r\n?", "\n")


def documents(spark: SparkSession, folder: str, raw: bool = False, required: bool = True) -> DataFrame:
    """documento_id (the file's stem) and texto of every *.txt file; line ends become \\n unless raw."""
    files = spark.read.option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").text(folder, wholetext=True)
    text = F.col("value") if raw else line_ends("value")
    out = files.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", "").alias("documento_id"), text.alias("texto"))
    if required and out.isEmpty():
        raise FileNotFoundError(f"no *.txt files in {folder}")
    return out


def id_set(ids: Column | str) -> Column:
    """The ids of a list parted by colons, none for null."""
    return F.coalesce(F.filter(F.split(ids, ":"), lambda x: x != ""), F.array().cast("array<string>"))


def gold(spark: SparkSession, path: str) -> DataFrame:
    """The gold table with ids as an array; the file may begin with a byte order mark."""
    rows = spark.read.csv(path, header=True, schema=schemas.GOLD, multiLine=True, escape='"', enforceSchema=True)
    return rows.withColumn("ids", id_set("id_canonico"))


def with_excerpts(gold_rows: DataFrame, docs: DataFrame) -> DataFrame:
    """trecho cut from the text where that is known, or else as the table has it, with its escapes resolved."""
    own = F.expr(r"replace(replace(replace(trecho, '\\r', '\r'), '\\n', '\n'), '\\t', '\t')")
    cut = F.substring(F.col("texto"), F.col("inicio") + 1, F.col("fim") - F.col("inicio"))
    return gold_rows.join(docs, "documento_id", "left").withColumn("trecho", F.coalesce(cut, own)).drop("texto")


def trace(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema=schemas.TRACE)


_TABLE = "faixas map<string,struct<confianca:double,acertos:bigint,total:bigint>>, por_metodo_decisao map<string,struct<confianca:double,acertos:bigint,total:bigint>>, padrao double"


def confidence_table(spark: SparkSession, path: str) -> DataFrame:
    """level (fine, coarse, default), key, confianca, acertos, total."""
    table = spark.read.json(path, schema=_TABLE, multiLine=True)
    bands = [table.select(F.lit(level).alias("level"), F.explode(column)).select("level", "key", "value.*") for level, column in (("fine", "faixas"), ("coarse", "por_metodo_decisao"))]
    none = F.lit(None).cast("long")
    default = table.where("padrao is not null").select(F.lit("default").alias("level"), F.lit("").alias("key"), F.col("padrao").alias("confianca"), none.alias("acertos"), none.alias("total"))
    return bands[0].unionByName(bands[1]).unionByName(default)


def table(spark: SparkSession, path: str, schema) -> DataFrame:
    """A CSV whose columns are read as the schema says."""
    return spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"')


def fingerprint(path: str) -> str:
    """SHA-256 of a local file, a MiB at a time."""
    found = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            found.update(part)
    return found.hexdigest()


def check_fresh(spark: SparkSession, catalog_path: str, expected: str) -> None:
    """Stops where the catalogue was built from another source than that with this fingerprint."""
    known = spark.read.json(f"{catalog_path}/manifest").first()
    if known is None or known["sha256"] != expected:
        raise ValueError(f"the catalogue in {catalog_path} was built from another source; build it again")
