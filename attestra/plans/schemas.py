"""Schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, B, D = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.DoubleType()  # noqa: E741


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


FIELDS = _struct(
    numero_normalizado=S, classe=S, classes_compostas=T.ArrayType(S), tribunal=S, uf=S, diploma=S, artigo=S, paragrafo=S,
    inciso=S, alinea=S, sumula=S, vinculante=B, ano=I, relator=S, orgao=S, variantes_texto=T.ArrayType(S),
)
PARSED = _struct(campos=FIELDS, ocr_corrigido=B)
CANDIDATE_SPAN = _struct(inicio=I, fim=I, trecho=S, tipo_bruto=S, tem_identificador=B, origem=S)
CATALOG_SOURCE = _struct(documento_id=S, id=L, tribunal=S, ano=I, relator=S, natureza=S, tipo=S, texto=S)
GOLD = _struct(nivel=I, documento_id=S, citacao_id=S, inicio=I, fim=I, trecho=S, tipo=S, classificacao=S, id_canonico=S)
TRACE = _struct(documento_id=S, inicio=I, fim=I, trecho=S, origem=S, metodo_busca=S, metodo_decisao=S, classificacao=S, id_canonico=L, confianca=D)
SUBMISSION = _struct(documento_id=S, citacoes=S)
SOLUTION = _struct(documento_id=S, nivel=I, citacoes=S)
TRACE_COLUMNS = TRACE.names
