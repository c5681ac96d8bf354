"""Registered queries of the text kernels: spans, fields, numbers and what is built from them, over generated texts.

Most texts are written as expressions that Spark and DuckDB read alike; what the engine finds in them is compared with
where the expression put it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.functions import columns as K
from attestra.functions.fixed_values import CLASSES, COURTS, STATUTE_BY_ID, STATUTES
from attestra.operators import catalog, checks, emit, fit, harness, judge, resolve, spans
from attestra.plans.derived import campos, query, spread, table
from attestra.sources import readers

_N = "cast(1000000 + o_custkey as string)"
#: The first seven digits, all there are for customer keys below 9,000,000.
_DOTTED = "substr({n}, 1, 1) || '.' || substr({n}, 2, 3) || '.' || substr({n}, 5, 3)".format(n=_N)
#: All digits in threes from the right, for keys of any size.
_GROUPED = "replace(format_number(1000000 + o_custkey, 0), ',', '.')"
_SMALL = "cast(100 + o_custkey % 800 as string)"
_CNJ = "lpad(cast(o_orderkey % 10000000 as string), 7, '0') || '-' || lpad(cast(o_custkey % 100 as string), 2, '0') || '.' || cast(2000 + o_orderkey % 20 as string) || '.5.' || lpad(cast(o_custkey % 90 as string), 2, '0') || '.0001'"
_CNJ_DIGITS = f"replace(replace({_CNJ}, '-', ''), '.', '')"
#: A header, its blank line and more text than the margin behind it.
_HEAD = "'head' || chr(10) || chr(10) || repeat('word ', cast(12 + o_custkey % 7 as int))"


def _pick(values: list[str], index: str) -> tuple[str, str]:
    """The value at index modulo their number, for Spark and for DuckDB."""
    listed = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"array({listed})[cast({index} % {len(values)} as int)]", f"[{listed}][({index} % {len(values)} + 1)::int]"


def _orders(spark, sf_dir) -> DataFrame:
    return spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderkey")


def _span_query(name: str, piece: str, kind: str = "jurisprudencia", known: bool = True, layer: str = "regex_camada1", before: str = _HEAD, after: str = "', no mais.'", kept: str = "true"):
    """Registers a query for spans that are found where an expression puts them."""
    sql = f"""select o_orderkey, length({before}) as inicio, length({before} || {piece}) as fim, {piece} as trecho, '{kind}' as tipo_bruto, {str(known).lower()} as tem_identificador, '{layer}' as origem
from orders where {kept}"""

    def run(spark, sf_dir):
        docs = _orders(spark, sf_dir).select(F.col("o_orderkey").cast("string").alias("documento_id"), F.expr(f"{before} || {piece} || {after}").alias("texto"))
        found = spans.extract(docs)
        where = [F.col(c).cast("long").alias(c) for c in ("inicio", "fim")]
        return found.select(F.col("documento_id").cast("long").alias("o_orderkey"), *where, "trecho", "tipo_bruto", "tem_identificador", "origem")

    query(sql, name)(run)


_span_query("span_law", f"'art. ' || {_SMALL} || ', § ' || cast(1 + o_orderkey % 9 as string) || 'º, do Código de Processo Civil'", kind="lei")
_span_query("span_summary", f"case when o_orderkey % 2 = 0 then 'Súmula Vinculante nº ' else '5úm. ' end || {_SMALL} || ' do STF'")
_span_query("span_theme", f"case when o_orderkey % 2 = 0 then 'Tema n. ' else 'Temã ' end || {_SMALL} || ' da repercussão geral'")
_span_query("span_bare_national", f"{_CNJ} || ' (RS)'")
_span_query("span_hyphened_national", f"'TST-ED-RR-' || {_CNJ}")
_span_query("span_class_chain", f"'Segundo AgRg no' || chr(10) || 'AREsp n. ' || {_DOTTED} || ' - PR'")
_span_query("span_incomplete", "'julgado do Supremo, proferido em ' || cast(1990 + o_custkey % 30 as string) || ' pela relatoria de Ana da Silva'", known=False, layer="heuristica_camada2")
_span_query("span_long_class", f"'Agravo Regimental em que se pede o de número ' || {_DOTTED}", layer="heuristica_camada2")
#: A clean national number is the document's own in the header and just behind it; so is one behind autos nº; offices' labels are none at all.
_span_query("span_distractors", f"case when o_orderkey % 4 = 2 then 'TST-RR-' else '' end || {_CNJ}", before="case o_orderkey % 4 when 0 then 'head ' when 1 then 'head' || chr(10) || chr(10) || repeat('word ', 12) || 'autos nº ' else 'head' || chr(10) || chr(10) || repeat('word ', 12) end", kept="o_orderkey % 4 > 1")


_MIXED = "'Ação nº ' || cast(o_custkey as string) || ' – §' || cast(o_orderkey % 10 as string) || ' “Rn” '"


@query(f"select o_orderkey, 'ACAO NO ' || o_custkey || ' SS' || (o_orderkey % 10) || ' RN' as plain, translate('ACAO NO ' || o_custkey || ' SS' || (o_orderkey % 10) || ' M', '015', 'OLS') as sign from orders")
def comparable_text(spark, sf_dir):
    text = F.expr(_MIXED)
    return _orders(spark, sf_dir).select("o_orderkey", K.comparable(text).alias("plain"), K.signature(text).alias("sign"))


_CLASS_NAMES = [(s, code) for code, spelled in CLASSES.items() for s in spelled]
_FIRST, _SECOND = (_pick([s for s, _ in _CLASS_NAMES], k) for k in ("o_custkey", "(o_orderkey + 7)"))
_CODE_1, _CODE_2 = (_pick([c for _, c in _CLASS_NAMES], k) for k in ("o_custkey", "(o_orderkey + 7)"))


@query(f"select o_orderkey, {_CODE_1[1]} || '>' || {_CODE_2[1]} as classes from orders")
def class_chain(spark, sf_dir):
    text = F.expr(f"{_FIRST[0]} || ' no ' || {_SECOND[0]} || ' 1.234/SP'")
    return _orders(spark, sf_dir).select("o_orderkey", F.array_join(K.class_chain(text), ">").alias("classes"))


_STATUTE_NAMES = [(s, code) for code, spelled in STATUTES.items() for s in spelled] + [("Constituição Fedcral", "CF"), ("Codigo Penal Mi1itar", "CPM"), ("Código de Defesa d0 Consumid0r", "CDC")]
_STATUTE, _STATUTE_CODE = _pick([s for s, _ in _STATUTE_NAMES], "o_custkey"), _pick([c for _, c in _STATUTE_NAMES], "o_custkey")


@query(f"select o_orderkey, case when o_orderkey % 4 > 0 then {_STATUTE_CODE[1]} end as diploma from orders")
def statute_lookup(spark, sf_dir):
    text = F.expr(f"case when o_orderkey % 4 > 0 then 'art. 5 do(a) ' || {_STATUTE[0]} else 'Lei nº 9.504/1997' end")
    return _orders(spark, sf_dir).select("o_orderkey", K.statute(text).alias("diploma"))


_COURT_NAMES = [(s, code) for code, spelled in COURTS.items() for s in spelled if "." not in s]
_COURT, _COURT_CODE = _pick([s for s, _ in _COURT_NAMES], "o_custkey"), _pick([c for _, c in _COURT_NAMES], "o_custkey")


@query(f"select o_orderkey, case when o_orderkey % 3 > 0 then {_COURT_CODE[1]} end as tribunal from orders")
def court_cited(spark, sf_dir):
    text = F.expr(f"case when o_orderkey % 3 > 0 then 'julgado do(a) ' || {_COURT[0]} || ', depois o STM' else 'sem corte' end")
    return _orders(spark, sf_dir).select("o_orderkey", K.court(text).alias("tribunal"))


_ROMAN, _ROMAN_SQL = _pick(["I", "II", "III", "IV", "V", "IX", "XL"], "o_custkey")
_LETTER, _LETTER_SQL = _pick(list("abcdef"), "o_orderkey")


@query(f"select o_orderkey, {_SMALL} as artigo, {_ROMAN_SQL} as inciso, {_LETTER_SQL} as alinea, 'CF' as diploma from orders")
def law_parts(spark, sf_dir):
    text = F.expr(f"'art. ' || {_SMALL} || 'º, inciso ' || {_ROMAN} || ', alínea \"' || {_LETTER} || '\", da CF'")
    return _orders(spark, sf_dir).select("o_orderkey", K.parse_fields(text, F.lit("lei"))["campos"].alias("c")).select("o_orderkey", "c.artigo", "c.inciso", "c.alinea", "c.diploma")


@query(f"select o_orderkey, case when o_orderkey % 3 < 2 then {_SMALL} end as sumula, o_orderkey % 3 = 0 as vinculante, case when o_orderkey % 3 = 2 then {_N} end as numero, case when o_orderkey % 3 = 2 then 7 else 0 end + case when case when o_orderkey % 3 = 2 then o_custkey % 1000 else 100 + o_custkey % 800 end = 515 then 2 else 0 end as variantes from orders")
def summary_fields(spark, sf_dir):
    """515 reads as SLS, a class of two spellings."""
    text = F.expr(f"case o_orderkey % 3 when 0 then 'Súmula Vinculante nº ' || {_SMALL} when 1 then 'sum. ' || {_SMALL} || ' do TST' else 'AgRg ' || {_GROUPED} end")
    c = K.parse_fields(text, F.lit("jurisprudencia"))["campos"]
    return _orders(spark, sf_dir).select("o_orderkey", c.alias("c")).select("o_orderkey", "c.sumula", "c.vinculante", F.col("c.numero_normalizado").alias("numero"), F.size("c.variantes_texto").alias("variantes"))


#: A court's formula behind the header, a chain that no year, date, registry or law is, and a national number behind a short one.
_OWN_TEXT = f"""case o_orderkey % 5
 when 0 then 'Lei nº 9.504/1997' || chr(10) || chr(10) || repeat('longo texto ', 100) || 'Vistos e examinados estes autos de Recurso nº TST-RR-' || {_CNJ} || ' e outros'
 when 1 then 'Julgado em 12/05/2010, RJ12345, lei nº 13.105, nº ' || {_GROUPED} || ' (' || {_CNJ} || ')'
 when 2 then 'Em 2010 o de ' || {_GROUPED} || ' veio'
 when 3 then 'Processo ' || {_CNJ} || chr(10) || 'EMENTA'
 else 'em 2010, sem mais' end"""


@query(f"select o_orderkey, case o_orderkey % 5 when 0 then {_CNJ_DIGITS} when 1 then {_N} || ',' || {_CNJ_DIGITS} when 2 then {_N} when 3 then {_CNJ_DIGITS} else '' end as numeros from orders")
def own_numbers(spark, sf_dir):
    court = F.expr("case when o_orderkey % 5 = 0 then 'TST' else 'STJ' end")
    return _orders(spark, sf_dir).select("o_orderkey", F.array_join(K.own_numbers(F.expr(_OWN_TEXT), court), ",").alias("numeros"))


_LAW_IDS = ", ".join(map(str, STATUTE_BY_ID))
_LISTED = "(select unnest([" + _LAW_IDS + "]) as id, unnest([" + ", ".join(f"'{c}'" for c in STATUTE_BY_ID.values()) + "]) as code) as listed"


@query(f"select o_orderkey, coalesce(code, 'CPC') as diploma, {_SMALL} as artigo from orders left join {_LISTED} on id = [{_LAW_IDS}][(o_orderkey % {2 * len(STATUTE_BY_ID)} + 1)::int]")
def statute_override(spark, sf_dir):
    ids = F.array(*(F.lit(i).cast("long") for i in STATUTE_BY_ID))
    own = F.coalesce(F.get(ids, (F.col("o_orderkey") % (2 * len(STATUTE_BY_ID))).cast("int")), F.col("o_orderkey"))
    text = F.expr(f"'Art. ' || {_SMALL} || '. Texto do Código de Processo Civil'")
    null = F.lit(None).cast("string")
    source = _orders(spark, sf_dir).select("o_orderkey", F.col("o_orderkey").cast("string").alias("documento_id"), own.alias("id"), null.alias("tribunal"), F.lit(2015).alias("ano"), null.alias("relator"), F.lit("dispositivo").alias("natureza"), F.lit("lei").alias("tipo"), text.alias("texto"))
    return catalog.build(source).select(F.col("documento_id").cast("long").alias("o_orderkey"), "campos.diploma", "campos.artigo")


@query("""select s.s_suppkey, n.n_nationkey as id, case when n.n_nationkey % 2 = s.s_suppkey % 2 then 1.0 else 0.5 end::double as score
from supplier s join nation n on s.s_suppkey % 10 = n.n_nationkey % 10 where not (s.s_suppkey % 3 = 0 and n.n_nationkey % 4 = 0)""")
def summary_match(spark, sf_dir):
    odd = lambda c: F.col(c) % 2 == 1
    number = lambda c: (F.col(c) % 10).cast("string")
    court = lambda test, name: F.when(test, F.lit(name))
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    records = n.select(F.col("n_nationkey").cast("long").alias("id"), court(F.col("n_nationkey") % 4 == 0, "TST").alias("tribunal"), F.lit("sumula").alias("natureza"), campos(sumula=number("n_nationkey"), vinculante=odd("n_nationkey")).alias("campos"), F.lit(None).cast("string").alias("hash_texto"), F.array().cast("array<string>").alias("numeros_alternativos"))
    asked = s.select("s_suppkey", F.lit("jurisprudencia").alias("tipo_bruto"), F.lit(True).alias("tem_identificador"), campos(sumula=number("s_suppkey"), vinculante=odd("s_suppkey"), tribunal=court(F.col("s_suppkey") % 3 == 0, "STF")).alias("campos"))
    return resolve.pairs(asked, records).select("s_suppkey", "k.id", "k.score")


# --- decisions, output and fit from orders: gold of one span for each order
def _gold(spark, sf_dir) -> DataFrame:
    o = _orders(spark, sf_dir)
    label = F.expr("case o_orderkey % 3 when 0 then 'real' when 1 then 'inventada' else 'incompleta' end")
    ids = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.col("o_custkey").cast("string"), F.lit("7"))).otherwise(F.array().cast("array<string>"))
    start = (10 * (F.col("o_orderkey") % 50)).cast("int")
    return o.select(F.col("o_custkey").cast("string").alias("documento_id"), (1 + F.col("o_custkey") % 2).cast("int").alias("nivel"), "o_orderkey", (start + 1000 * (F.col("o_orderkey") % 1000).cast("int")).alias("inicio"), (start + 1000 * (F.col("o_orderkey") % 1000).cast("int") + 20).alias("fim"), F.lit("x").alias("trecho"), label.alias("classificacao"), ids.alias("ids"))


_GOLD_START = "10 * (o_orderkey % 50) + 1000 * (o_orderkey % 1000)"
_GOLD_SQL = f"g as (select o_custkey, o_orderkey, {_GOLD_START} as a, case o_orderkey % 3 when 0 then 'real' when 1 then 'inventada' else 'incompleta' end as label from orders)"


@query(f"""with {_GOLD_SQL} select o_custkey, (1 + o_custkey % 2)::int as nivel, string_agg(a || ',' || (a + 20) || ',' || label || ',' || case when label = 'real' then o_custkey || ':7' else '-' end, '|'
  order by a, a || ',' || (a + 20) || ',' || label || ',' || case when label = 'real' then o_custkey || ':7' else '-' end) as citacoes from g group by all""")
def gold_submission(spark, sf_dir):
    return emit.from_gold(_gold(spark, sf_dir)).select(F.col("documento_id").cast("long").alias("o_custkey"), "nivel", "citacoes")


@query(f"""with {_GOLD_SQL} select o_custkey, a as g0, a + 20 as g1, case when o_orderkey % 4 < 3 then a + 5 * (o_orderkey % 4) end as s0, case when o_orderkey % 4 < 3 then a + 5 * (o_orderkey % 4) + 20 end as s1,
  round(case o_orderkey % 4 when 0 then 1.0 when 1 then 15 / 25.0 when 2 then 10 / 30.0 else 0 end, 9)::double as iou from g where o_orderkey % 1000 < 900 and o_custkey % 5 > 0 group by all having count(*) = 1
union all select o_custkey, null, null, a + 5 * (o_orderkey % 4), a + 5 * (o_orderkey % 4) + 20, 0 from g where o_orderkey % 1000 < 900 and o_custkey % 5 > 0 and o_orderkey % 4 = 2 group by all having count(*) = 1""")
def extraction_check(spark, sf_dir):
    """Gold spans and spans moved by 0, 5 or 10 places, one in four not found; only orders whose span is alone in its document's thousand."""
    g = _gold(spark, sf_dir).where("o_orderkey % 1000 < 900 and cast(documento_id as long) % 5 > 0")
    g = g.join(g.groupBy("documento_id", "inicio").count().where("count = 1"), ["documento_id", "inicio"])
    move = (5 * (F.col("o_orderkey") % 4)).cast("int")
    found = g.where("o_orderkey % 4 < 3").select("documento_id", (F.col("inicio") + move).alias("inicio"), (F.col("fim") + move).alias("fim"))
    out = checks.extraction_report(g, found)
    return out.select(F.col("documento_id").cast("long").alias("o_custkey"), *(F.col(c).cast("long").alias(c) for c in ("g0", "g1", "s0", "s1")), F.round("iou", 9).alias("iou"))


@query(f"""with {_GOLD_SQL} select 'offset' as kind, o_custkey, 'x' as value from g where o_orderkey % 2 = 1
union all select 'document without gold', c_custkey, '' from customer where c_custkey not in (select o_custkey from orders)
union all select 'unknown id', o_custkey, '7' from g where label = 'real'
union all select 'unknown id', o_custkey, o_custkey::varchar from g where label = 'real' and (o_custkey % 2 = 0 or o_custkey = 7)""")
def gold_check(spark, sf_dir):
    """Excerpts are y where the text has x; ids are those of odd customers."""
    place = (F.col("o_orderkey") % 50).cast("int")
    g = _gold(spark, sf_dir).withColumns({"inicio": place, "fim": place + 20, "trecho": F.when(F.col("o_orderkey") % 2 == 1, "x").otherwise(F.repeat(F.lit("y"), F.lit(20)))})
    c = table(spark, sf_dir, "customer")
    docs = c.select(F.col("c_custkey").cast("string").alias("documento_id"), F.repeat(F.lit("y"), F.lit(100)).alias("texto"))
    source = c.where("c_custkey % 2 = 1 and c_custkey <> 7").select(F.col("c_custkey").alias("id"))
    found = checks.gold_report(g, docs, source)
    return found.select("kind", F.col("documento_id").cast("long").alias("o_custkey"), "value")


def _trace(spark, sf_dir) -> DataFrame:
    """A decision for each gold span, right in class but for one in five and in id but for one in seven."""
    g = _gold(spark, sf_dir)
    wrong = F.col("o_orderkey") % 5 == 0
    label = F.when(wrong, "incompleta").otherwise(F.col("classificacao"))
    own = F.when(F.col("o_orderkey") % 7 == 0, F.lit(-1).cast("long")).otherwise(F.col("documento_id").cast("long"))
    return g.select("o_orderkey", "documento_id", "inicio", "fim", "trecho", F.lit("regex_camada1").alias("origem"), F.expr("case when o_orderkey % 2 = 0 then 'catalogo' end").alias("metodo_busca"), F.lit("m").alias("metodo_decisao"), label.alias("classificacao"), F.when(label == "real", own).alias("id_canonico"), (F.col("o_orderkey") % 10 / 10).alias("confianca"))


@query(f"with {_GOLD_SQL} select o_custkey, a as inicio, a + 20 as fim, case when o_orderkey % 5 = 0 then 'incompleta' else label end as classificacao, case when label = 'real' and o_orderkey % 5 > 0 then case when o_orderkey % 7 = 0 then -1 else o_custkey end end as id_canonico, o_orderkey % 10 / 10.0::double as confianca from g")
def trace_rows(spark, sf_dir):
    return emit.trace(_trace(spark, sf_dir)).select(F.col("documento_id").cast("long").alias("o_custkey"), F.col("inicio").cast("long"), F.col("fim").cast("long"), "classificacao", "id_canonico", "confianca")


@query(f"""with {_GOLD_SQL}, u as (select * from g where (o_custkey, a) in (select o_custkey, a from g group by all having count(*) = 1))
select o_custkey, 'm' as metodo_decisao, case when o_orderkey % 2 = 0 then 'catalogo' else '-' end as metodo_busca, ((case when o_orderkey % 5 = 0 then 'incompleta' else label end) = label and (label <> 'real' or o_orderkey % 7 > 0))::int as hit from u""")
def fit_labels(spark, sf_dir):
    g, t = _gold(spark, sf_dir), _trace(spark, sf_dir)
    once = g.groupBy("documento_id", "inicio").count().where("count = 1").drop("count")
    found = fit.labels(t.join(once, ["documento_id", "inicio"]), g.join(once, ["documento_id", "inicio"]))
    return found.select(F.col("documento_id").cast("long").alias("o_custkey"), "metodo_decisao", "metodo_busca", "hit")


@query("select o_orderkey, case when o_orderkey % 4 = 0 then 0.0 when o_custkey % 30 < 10 then 0.1 when o_custkey % 30 < 20 then round(0.1 * (1 - (o_custkey % 10) / 10.0), 9) else 0.0 end::double as bonus from orders")
def bonus_clamp(spark, sf_dir):
    """A Brier value that is null, below 0, within 0 and 1, or above 1."""
    value = F.expr("case when o_orderkey % 4 = 0 then null when o_custkey % 30 < 10 then -0.5d when o_custkey % 30 < 20 then (o_custkey % 10) / 10 else 1.5d end")
    return _orders(spark, sf_dir).select("o_orderkey", F.round(fit.bonus(value), 9).alias("bonus"))


_SLICES = "select o_orderkey, unnest([" + ", ".join(f"{{'s': '{n}', 'c': '{c}', 'm': '{m}', 'w': {'null' if w is None else w}::bigint}}" for n, _, _, c, m, w in harness.SLICES) + "]) as x from orders"


@query(f"with s as ({_SLICES}) select 1000 * o_orderkey as base, x.s as slice, x.c as classificacao, x.m as metodo_decisao, 1000 * o_orderkey + x.w as id_canonico from s")
def harness_slices(spark, sf_dir):
    decided = harness.run(spark, _orders(spark, sf_dir).select((1000 * F.col("o_orderkey")).alias("id")))
    return decided.select("base", "slice", "classificacao", "metodo_decisao", "id_canonico")


_RIGHT = sum(1 for s in harness.SLICES if s[4] == "cardinalidade_1")
_REAL = sum(1 for s in harness.SLICES if s[3] == "real")
_OPEN = sum(1 for s in harness.SLICES if s[3] == "incompleta")
_F1_REAL, _F1_OPEN = 2 * _RIGHT / (_RIGHT + _REAL), 2 * _OPEN / (2 * _OPEN + _REAL - _RIGHT)


@query(f"select 'as decided' as run, 1.0 as macro_f1, 0.0 as tau, 1.0 as score union all select 'without ties', round({(1 + _F1_REAL + _F1_OPEN) / 3}, 9), 0.0, round({(1 + _F1_REAL + _F1_OPEN) / 3}, 9)")
def harness_metric(spark, sf_dir):
    """The harness's own score of its slices for every order, and what it were without the tie-break by class."""
    decided = harness.run(spark, _orders(spark, sf_dir).select((1000 * F.col("o_orderkey")).alias("id")))
    both = [harness.scores(rows).select(F.lit(name).alias("run"), *(F.round(c, 9).alias(c) for c in ("macro_f1", "tau", "score"))) for name, rows in (("as decided", decided), ("without ties", harness.without(decided, ["desempate_classe"])))]
    return both[0].unionByName(both[1])


def _undecided(spark, sf_dir) -> DataFrame:
    """Two candidates for each order, that of the smaller id with the better score."""
    o = _orders(spark, sf_dir)
    null = F.lit(None).cast("string")
    cand = lambda i, s: F.struct(i.alias("id"), null.alias("tribunal"), F.lit("acordao").alias("natureza"), s.cast("double").alias("score"), F.array().cast("array<string>").alias("conflitos_duros"), F.array().cast("array<string>").alias("divergencias_brandas"), F.array().cast("array<string>").alias("classes_compostas"), null.alias("hash_texto"))
    both = F.array(cand(F.col("o_orderkey"), F.lit(1.0)), cand(F.col("o_orderkey") + 1_000_000, F.when(F.col("o_custkey") % 3 == 0, 1.0).when(F.col("o_custkey") % 3 == 1, 0.9).otherwise(0.5)))
    return o.select("o_orderkey", F.concat(F.lit("REsp "), F.col("o_custkey").cast("string")).alias("trecho"), F.lit("lei_sumula").alias("metodo_busca"), F.lit("jurisprudencia").alias("tipo_bruto"), campos(classes_compostas=F.array()).alias("campos"), both.alias("candidatos"))


@query("select o_orderkey, case o_custkey % 3 when 2 then 'desempate_score' else 'cardinalidade_2mais' end as metodo_decisao, case o_custkey % 3 when 2 then o_orderkey end as id_canonico from orders")
def tiebreak_score(spark, sf_dir):
    rows = resolve.decide(_undecided(spark, sf_dir), resolve.Rules(score=True, margin=0.3))
    return rows.select("o_orderkey", "metodo_decisao", "id_canonico")


class _SecondIfOdd:
    """Answers with the larger id for an excerpt that ends in an odd digit, with an id that isn't asked about for 0, else with none."""

    def answer(self, prompt: str) -> str:
        excerpt, ids = (line.split(": ", 1)[1] for line in prompt.split("\n")[:3] if line.startswith(("Citation", "Ids")))
        last = int(excerpt[-1])
        said = ids.split(", ")[1] if last % 2 else "-5" if last == 0 else "null"
        return f'As asked:\n```json\n{{"id_canonico": {said}, "justificativa": "digit {last}"}}\n``` Done.'


@query("select o_orderkey, 'juiz' as metodo_decisao, case when o_custkey % 2 = 1 then 'real' else 'incompleta' end as classificacao, case when o_custkey % 2 = 1 then o_orderkey + 1000000 end as id_canonico from orders")
def judge_decision(spark, sf_dir):
    asked = _undecided(spark, sf_dir)
    rows = resolve.decide(asked, resolve.Rules(judge=judge.judged(asked, _SecondIfOdd())))
    return rows.select("o_orderkey", "metodo_decisao", "classificacao", "id_canonico")


@query("""with t as (select doc_id, replace(replace(text, ', ', ',' || chr(10)), '. ', '.' || chr(10)) as t from documents) select doc_id, sha1(t) as hash, length(t) as n from t""")
def read_document(spark, sf_dir):
    """Texts with line ends of both other kinds."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr("replace(replace(text, ', ', concat(',', chr(13), chr(10))), '. ', concat('.', chr(13)))").alias("raw"))
    text = readers.line_ends("raw")
    return d.select("doc_id", F.sha1(F.encode(text, "UTF-8")).alias("hash"), F.length(text).cast("long").alias("n"))
