"""The decision on its own: generated slices with known answers, exactness, and what tie-breaks and judges would change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.operators import metric
from attestra.operators.resolve import Rules, decide

#: slice, metodo_busca, candidates as (id offset, score, conflicts, classes, signature), class, method, id offset.
_CITED = ["REsp"]
SLICES = (
    ("not searched", "sem_busca", [], "incompleta", "sem_identificador", None),
    ("no search method", None, [(0, 1.0, [], [], "a")], "incompleta", "sem_identificador", None),
    ("none found", "catalogo", [], "inventada", "cardinalidade_0", None),
    ("no law found", "lei_sumula", [], "inventada", "cardinalidade_0", None),
    ("one", "catalogo", [(0, 1.0, [], [], "a")], "real", "cardinalidade_1", 0),
    ("one twice", "catalogo", [(0, 1.0, [], [], "a"), (0, 1.0, [], [], "a")], "real", "cardinalidade_1", 0),
    ("one beside conflicts", "catalogo", [(0, 1.0, [], [], "a"), (1, 1.0, ["uf"], [], "b"), (2, 1.0, ["uf"], [], "c")], "real", "cardinalidade_1", 0),
    ("all in conflict", "catalogo", [(0, 1.0, ["uf"], [], "a"), (1, 1.0, ["uf"], [], "b")], "inventada", "veto_quimera", None),
    ("two", "catalogo", [(0, 1.0, [], [], "a"), (1, 1.0, [], [], "b")], "incompleta", "cardinalidade_2mais", None),
    ("two, one chain", "catalogo", [(0, 1.0, [], ["AgInt"], "a"), (1, 1.0, [], _CITED, "b")], "real", "desempate_classe", 1),
    ("two of a chain", "catalogo", [(0, 1.0, [], _CITED, "a"), (1, 1.0, [], _CITED, "b")], "incompleta", "cardinalidade_2mais", None),
)
_CANDIDATE = "struct<id:bigint,tribunal:string,natureza:string,score:double,conflitos_duros:array<string>,divergencias_brandas:array<string>,classes_compostas:array<string>,hash_texto:string>"
_SCHEMA = f"slice string, metodo_busca string, tipo_bruto string, campos struct<classes_compostas:array<string>>, candidatos array<{_CANDIDATE}>, want_class string, want_method string, want bigint"


def slices(spark: SparkSession, bases: DataFrame) -> DataFrame:
    """Every slice for every id of bases(id), ids moved by it; with the class, method and id to be decided."""
    rows = [(n, how, "jurisprudencia", (_CITED,), [(i, "STJ", "acordao", s, c, [], k, h) for i, s, c, k, h in cands], label, method, want) for n, how, cands, label, method, want in SLICES]
    every = spark.createDataFrame(rows, _SCHEMA).crossJoin(bases.select(F.col("id").alias("base")))  # as many slices as are listed above
    moved = F.transform("candidatos", lambda k: k.withField("id", k["id"] + F.col("base")))
    return every.withColumns({"candidatos": moved, "want": F.col("want") + F.col("base")})


def inexact(decided: DataFrame) -> DataFrame:
    """Rows whose class, method or id isn't the wanted one."""
    same = F.col("classificacao").eqNullSafe(F.col("want_class")) & F.col("metodo_decisao").eqNullSafe(F.col("want_method")) & F.col("id_canonico").eqNullSafe(F.col("want"))
    return decided.where(~same)


def judge_precision(decided: DataFrame) -> DataFrame:
    """asked and right: decisions of the judge, and those with the wanted id."""
    asked = decided.where("metodo_decisao = 'juiz'")
    return asked.agg(F.count(F.lit(1)).alias("asked"), F.count_if(F.col("id_canonico").eqNullSafe(F.col("want"))).alias("right"))


def scores(decided: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Class by class and overall scores of decisions against want_class and want, without matching of spans."""
    right = (F.col("classificacao") == F.col("want_class")) & ((F.col("want_class") != "real") | F.col("id_canonico").eqNullSafe(F.col("want")))
    same = F.col("classificacao") == F.col("want_class")
    grave = (F.col("want_class") == "inventada") & (F.col("classificacao") == "real")
    event = lambda label, tp, fp, fn, support, g: F.struct(label.alias("classe"), *(x.cast("long").alias(n) for n, x in (("tp", tp), ("fp", fp), ("fn", fn), ("support", support), ("grave", g))), F.lit(None).cast("double").alias("brier"))
    zero = F.lit(0)
    both = F.array(event(F.col("want_class"), right, zero, ~same, F.lit(1), grave), event(F.col("classificacao"), zero, ~right, zero, zero, zero))
    counted = decided.select(*by, F.explode(both).alias("e")).select(*by, "e.*")
    return metric.level_scores(metric.confusion(counted, by), by)


def without(decided: DataFrame, methods: list[str]) -> DataFrame:
    """The decisions if these tie-breaks weren't there: what they settled is incomplete."""
    gone = F.col("metodo_decisao").isin(*methods)
    change = lambda c, value: F.when(gone, F.lit(value)).otherwise(F.col(c))
    return decided.withColumns({"classificacao": change("classificacao", "incompleta"), "id_canonico": change("id_canonico", None), "metodo_decisao": change("metodo_decisao", "cardinalidade_2mais")})


def projected(decided: DataFrame, perfect: bool) -> DataFrame:
    """The decisions if a judge settled what is left with two or more: always rightly, or always with the first candidate."""
    open_ = F.col("metodo_decisao") == "cardinalidade_2mais"
    first = F.array_min(F.transform("candidatos", lambda k: k["id"]))
    choice = F.col("want") if perfect else first
    label = F.when(choice.isNotNull(), "real").otherwise("incompleta")
    return decided.withColumns({"classificacao": F.when(open_, label).otherwise(F.col("classificacao")), "id_canonico": F.when(open_, choice).otherwise(F.col("id_canonico"))})


def diagnostics(decided: DataFrame) -> DataFrame:
    """Citations by number of candidates, conflicts, differences and method."""
    some = lambda name: F.size(F.filter("candidatos", lambda k: F.size(k[name]) > 0))
    facts = decided.select(F.size("candidatos").alias("candidates"), some("conflitos_duros").alias("in_conflict"), some("divergencias_brandas").alias("differing"), "metodo_decisao", (F.col("tipo") != F.col("tipo_bruto")).alias("other_kind"))
    return facts.groupBy(*facts.columns).count()


def run(spark: SparkSession, bases: DataFrame, rules: Rules = Rules()) -> DataFrame:
    return decide(slices(spark, bases), rules)


def error_rows(decided: DataFrame) -> Column:
    """What is wrong with each decision, for a table of errors."""
    ids = F.when(F.col("want").isNotNull(), F.array(F.col("want").cast("string"))).otherwise(F.array().cast("array<string>"))
    return metric.category(F.col("want_class"), ids, F.col("classificacao"), F.col("id_canonico").cast("string"))
