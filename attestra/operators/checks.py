"""Invariants of a run and the report on the data's quality, as rows of what is wrong."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.functions.columns import iou
from attestra.functions.fixed_values import SAME_SPAN_IOU


class InvariantError(AssertionError):
    """A run's output breaks a rule."""


def violations(docs: DataFrame, decided: DataFrame, submission: DataFrame) -> DataFrame:
    """documento_id, inicio and rule of everything in a run's output that breaks a rule."""
    none = F.lit(None).cast("int").alias("inicio")
    of = lambda rows, rule, start=None: rows.select("documento_id", none if start is None else F.col(start).cast("int").alias("inicio"), F.lit(rule).alias("rule"))
    cut = decided.join(docs, "documento_id").where(F.substring(F.col("texto"), F.col("inicio") + 1, F.col("fim") - F.col("inicio")) != F.col("trecho"))
    linked = decided.where((F.col("classificacao") == "real") != F.col("id_canonico").isNotNull())
    sure = decided.where("confianca < 0 or confianca > 1 or isnan(confianca)")
    a, b = decided.select("documento_id", "inicio", "fim").alias("a"), decided.select("documento_id", "inicio", "fim").alias("b")
    later = F.struct("a.inicio", "a.fim") < F.struct("b.inicio", "b.fim")
    same = a.join(b, (F.col("a.documento_id") == F.col("b.documento_id")) & later).where(iou(F.col("a.inicio"), F.col("a.fim"), F.col("b.inicio"), F.col("b.fim")) >= SAME_SPAN_IOU)
    same = same.select("a.documento_id", "a.inicio")
    lost = docs.join(submission, "documento_id", "left_anti")
    silent = submission.join(decided, "documento_id", "left_anti").where("citacoes <> '-'")
    found = [of(cut, "trecho", "inicio"), of(linked, "real and id", "inicio"), of(sure, "confidence", "inicio"), of(same, "overlap", "inicio"), of(lost, "document lost"), of(silent, "cell without citations")]
    return reduce(DataFrame.unionByName, found)


def require(found: DataFrame) -> None:
    if rows := found.limit(20).collect():
        raise InvariantError("; ".join(f"[{r['documento_id']}:{r['inicio']}] {r['rule']}" for r in rows))


@F.arrow_udf(T.BooleanType())
def is_composed(texts: pa.Array) -> pa.Array:
    """Whether a text is in normal form C."""
    return pa.array([None if t is None else unicodedata.is_normalized("NFC", t) for t in texts.to_pylist()], pa.bool_())


def text_report(docs: DataFrame) -> DataFrame:
    """One row: documents, those with \\r\\n, with a byte order mark and not composed, and the least, upper middle and greatest length."""
    rows = docs.select(F.length("texto").alias("n"), F.col("texto").contains("\r\n").alias("crlf"), F.col("texto").startswith("﻿").alias("bom"), (~is_composed("texto")).alias("loose"))
    counted = rows.agg(F.count(F.lit(1)).alias("documents"), F.count_if("crlf").alias("crlf"), F.count_if("bom").alias("bom"), F.count_if("loose").alias("not_composed"), F.min("n").alias("shortest"), F.max("n").alias("longest"))
    # the element after half of them, by counts of each length and not by a sort of all rows into one task
    sizes = rows.groupBy("n").count()
    ranked = sizes.withColumn("upto", F.expr("sum(count) over (order by n)")).crossJoin(sizes.agg(F.sum("count").alias("of")))
    middle = ranked.where("upto > floor(of / 2)").agg(F.min("n").alias("middle"))
    return counted.crossJoin(middle)


def source_report(source: DataFrame) -> DataFrame:
    """natureza, tribunal, rows and distinct ids of the catalogue's source."""
    return source.groupBy("natureza", "tribunal").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("ids"))


def gold_report(gold: DataFrame, docs: DataFrame, source: DataFrame) -> DataFrame:
    """What in the gold doesn't fit: kind, documento_id, value."""
    cut = gold.join(docs, "documento_id").where(F.substring(F.col("texto"), F.col("inicio") + 1, F.col("fim") - F.col("inicio")) != F.col("trecho"))
    ids = gold.select("documento_id", F.explode("ids").alias("value"))
    parts = [
        cut.select(F.lit("offset").alias("kind"), "documento_id", F.col("trecho").alias("value")),
        docs.join(gold, "documento_id", "left_anti").select(F.lit("document without gold").alias("kind"), "documento_id", F.lit("").alias("value")),
        ids.join(source.select(F.col("id").cast("string").alias("value")), "value", "left_anti").select(F.lit("unknown id").alias("kind"), "documento_id", "value"),
    ]
    return reduce(DataFrame.unionByName, parts)


def extraction_report(gold: DataFrame, spans: DataFrame) -> DataFrame:
    """Each gold span with its best extracted span (the earlier one of equals), and extracted spans that meet none."""
    g, s = gold.select("documento_id", F.col("inicio").alias("g0"), F.col("fim").alias("g1")), spans.select("documento_id", F.col("inicio").alias("s0"), F.col("fim").alias("s1"))
    near = g.join(s, "documento_id").withColumn("iou", iou(F.col("g0"), F.col("g1"), F.col("s0"), F.col("s1")))
    best = near.groupBy("documento_id", "g0", "g1").agg(F.max_by(F.struct("s0", "s1", "iou"), F.struct("iou", -F.col("s0"))).alias("b"))
    rows = g.join(best, ["documento_id", "g0", "g1"], "left").select("documento_id", "g0", "g1", F.when(F.col("b.iou") > 0, F.col("b.s0")).alias("s0"), F.when(F.col("b.iou") > 0, F.col("b.s1")).alias("s1"), F.coalesce("b.iou", F.lit(0.0)).alias("iou"))
    spare = s.join(near.where(f"iou >= {SAME_SPAN_IOU}").select("documento_id", "s0", "s1"), ["documento_id", "s0", "s1"], "left_anti")
    none = F.lit(None).cast("int")
    return rows.unionByName(spare.select("documento_id", none.alias("g0"), none.alias("g1"), "s0", "s1", F.lit(0.0).alias("iou")))
