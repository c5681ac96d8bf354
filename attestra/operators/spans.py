"""Spans: extraction, filters and the greedy interval de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions import columns as K
from attestra.functions import fixed_values as V

_LAYERS = {"regex_camada1": 0, "heuristica_camada2": 1, "agente_extrator_llm": 2}


def priority(origin: Column) -> Column:
    out = F.lit(99)
    for name, rank in _LAYERS.items():
        out = F.when(origin == name, rank).otherwise(out)
    return out


def distractor(start: Column, text: Column, before: Column, header: Column) -> Column:
    """A clean national number in or just after the header, a number of the own case file, or an office label at the start."""
    own = (start < header + V.HEADER_MARGIN) & text.rlike(V.CLEAN_CNJ)
    return own | before.rlike(rf"(?iuU){V.OWN_AUTOS}") | text.rlike(rf"(?iuU)^{V.DISTRACTOR}")


def long_enough(spans: DataFrame, least: int = V.SPAN_LEAST) -> DataFrame:
    return spans.where(F.col("fim") - F.col("inicio") >= least)


def without_overlaps(spans: Column) -> Column:
    """Of an array of spans those that a greedy choice keeps: by layer, length (longest first) and start; one that
    lies within a kept span, or meets one with an overlap of half the union, is dropped."""
    rank = lambda s: F.struct(priority(s["origem"]).alias("p"), (s["inicio"] - s["fim"]).alias("n"), s["inicio"].alias("a"), s.alias("s"))
    ordered = F.transform(F.sort_array(F.transform(spans, rank)), lambda r: r["s"])

    def clash(s: Column, k: Column) -> Column:
        inside = (k["inicio"] <= s["inicio"]) & (s["fim"] <= k["fim"])
        return inside | (K.iou(s["inicio"], s["fim"], k["inicio"], k["fim"]) >= V.SAME_SPAN_IOU)

    def chosen(ordered: Column) -> Column:
        none = F.filter(ordered, lambda s: F.lit(False))
        return F.aggregate(ordered, none, lambda kept, s: F.when(F.exists(kept, lambda k: clash(s, k)), kept).otherwise(F.concat(kept, F.array(s))))

    # a single span needs no choice
    return K.let(ordered, lambda o: F.when(F.size(o) < 2, o).otherwise(chosen(o)))


def extract(docs: DataFrame) -> DataFrame:
    """docs(documento_id, texto) to one row for each citation span; documents without one have none.

    Only the spans of a document are kept past this step, never its text. No filter reads the spans: it would move below
    the projection, and below a shuffle of its input, and have every text searched twice.
    """
    found = docs.select("documento_id", "texto", K.header_end("texto").alias("header"), K.candidate_spans("texto").alias("spans"))
    reach = V.OWN_AUTOS_REACH
    before = lambda s: F.substring(F.col("texto"), F.greatest(s["inicio"] - reach, F.lit(0)) + 1, F.least(s["inicio"], F.lit(reach)))
    kept = F.filter("spans", lambda s: (s["fim"] - s["inicio"] >= V.SPAN_LEAST) & ~distractor(s["inicio"], s["trecho"], before(s), F.col("header")))
    # outer and over a column: see resolve.decide
    chosen = found.select("documento_id", without_overlaps(kept).alias("_s")).select("documento_id", F.explode_outer("_s").alias("s"))
    return chosen.where("s is not null").select("documento_id", "s.*")


def normalise(spans: DataFrame) -> DataFrame:
    """Adds campos and ocr_corrigido; a span without an identifier has no fields."""
    text = F.when(F.col("tem_identificador"), F.col("trecho"))
    return spans.withColumn("_p", K.parse_fields(text, F.col("tipo_bruto"))).withColumns({"campos": F.col("_p.campos"), "ocr_corrigido": F.col("_p.ocr_corrigido")}).drop("_p")
