"""A whole run: documents to citations with class, record and confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame

from attestra.operators import resolve, spans


def resolved(found: DataFrame, records: DataFrame, table: DataFrame | None = None, rules: resolve.Rules = resolve.Rules()) -> DataFrame:
    """Spans (documento_id, inicio, fim, trecho, tipo_bruto, tem_identificador, origem) to decided citations."""
    return resolve.calibrate(resolve.decide(resolve.search(spans.normalise(found), records), rules), table)


def run(docs: DataFrame, records: DataFrame, table: DataFrame | None = None, rules: resolve.Rules = resolve.Rules()) -> DataFrame:
    return resolved(spans.extract(docs), records, table, rules)
