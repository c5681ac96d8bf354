"""Confidence bands from labelled decisions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.operators import metric

ALPHA = BETA = 1.0


def labels(trace: DataFrame, gold: DataFrame) -> DataFrame:
    """documento_id, metodo_decisao, metodo_busca and hit (0 or 1) of each prediction that matches a gold span.

    Documents without gold are left out. Ids are compared as they are written.
    """
    golds = gold.groupBy("documento_id").agg(F.array_sort(F.collect_list(F.struct("inicio", "fim", "classificacao", "ids"))).alias("golds"))
    preds = trace.groupBy("documento_id").agg(F.array_sort(F.collect_list(F.struct("inicio", "fim", "classificacao", F.col("id_canonico").cast("string").alias("id"), "metodo_decisao", "metodo_busca"))).alias("preds"))
    rows = golds.join(preds, "documento_id").select("documento_id", "golds", "preds", F.explode(metric.matched(F.col("golds"), F.col("preds"))).alias("u"))
    g, p = F.element_at("golds", F.col("u.g") + 1), F.element_at("preds", F.col("u.p") + 1)
    right = (g["classificacao"] == p["classificacao"]) & ((g["classificacao"] != "real") | F.coalesce(F.array_contains(g["ids"], p["id"]), F.lit(False)))
    return rows.select("documento_id", F.coalesce(p["metodo_decisao"], F.lit("-")).alias("metodo_decisao"), F.coalesce(p["metodo_busca"], F.lit("-")).alias("metodo_busca"), right.cast("int").alias("hit"))


def smoothed(hits: Column, n: Column) -> Column:
    return F.bround((hits + ALPHA) / (n + ALPHA + BETA), 4)


def table(labelled: DataFrame) -> DataFrame:
    """level, key, confianca, acertos, total: fine and coarse bands and the default in one pass of grouping sets."""
    rows = labelled.groupingSets([["metodo_decisao", "metodo_busca"], ["metodo_decisao"], []], "metodo_decisao", "metodo_busca")
    rows = rows.agg(F.grouping_id().alias("g"), F.sum("hit").alias("acertos"), F.count(F.lit(1)).alias("total"))
    level = F.when(F.col("g") == 0, "fine").when(F.col("g") == 1, "coarse").otherwise("default")
    key = F.when(F.col("g") == 0, F.concat_ws("|", "metodo_decisao", "metodo_busca")).when(F.col("g") == 1, F.col("metodo_decisao")).otherwise("")
    return rows.select(level.alias("level"), key.alias("key"), smoothed(F.col("acertos"), F.col("total")).alias("confianca"), "acertos", "total").where("total > 0")


def brier(labelled: DataFrame, bands: DataFrame) -> DataFrame:
    fine = bands.where("level = 'fine'").select(F.col("key").alias("k"), "confianca")
    return labelled.join(fine, F.concat_ws("|", "metodo_decisao", "metodo_busca") == F.col("k")).agg(F.avg(F.pow(F.col("confianca") - F.col("hit"), 2)).alias("brier"))


def leave_one_out(labelled: DataFrame) -> DataFrame:
    """brier with each document's labels judged by a table of all others: totals less the document's own counts."""
    fine, coarse = ["metodo_decisao", "metodo_busca"], ["metodo_decisao"]
    sums = lambda rows, by, tag: rows.groupBy(*by).agg(F.sum("hit").alias(f"h_{tag}"), F.count(F.lit(1)).alias(f"n_{tag}"))
    rows = labelled.join(sums(labelled, fine, "f"), fine).join(sums(labelled, coarse, "c"), coarse)
    rows = rows.join(sums(labelled, ["documento_id", *fine], "df"), ["documento_id", *fine]).join(sums(labelled, ["documento_id", *coarse], "dc"), ["documento_id", *coarse])
    rows = rows.join(sums(labelled, ["documento_id"], "d"), "documento_id").crossJoin(labelled.agg(F.sum("hit").alias("h"), F.count(F.lit(1)).alias("n")))
    band = lambda h, n: F.when(n > 0, smoothed(h, n))
    c = F.col
    value = F.coalesce(band(c("h_f") - c("h_df"), c("n_f") - c("n_df")), band(c("h_c") - c("h_dc"), c("n_c") - c("n_dc")), band(c("h") - c("h_d"), c("n") - c("n_d")), F.lit(ALPHA / (ALPHA + BETA)))
    return rows.agg(F.avg(F.pow(value - c("hit"), 2)).alias("brier"))


def bonus(value: Column) -> Column:
    return F.when(value.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(metric.BONUS), metric.BONUS * (1 - value))))


def as_json(bands: DataFrame) -> str:
    """The table as JSON; as many bands as there are pairs of methods."""
    out: dict = {"faixas": {}, "por_metodo_decisao": {}, "padrao": None, "alfa": ALPHA, "beta": BETA}
    for r in bands.orderBy("level", "key").toLocalIterator():
        if r["level"] == "default":
            out["padrao"] = r["confianca"]
        else:
            out["faixas" if r["level"] == "fine" else "por_metodo_decisao"][r["key"]] = {"confianca": r["confianca"], "acertos": r["acertos"], "total": r["total"]}
    return json.dumps(out, ensure_ascii=False, indent=2)
