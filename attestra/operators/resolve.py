"""Resolution: citations against the catalogue by equality joins, with scores, conflicts and the decision.

The catalogue is indexed before the one join (one row for each key, summary or article, with its records as an array), so a
citation stays one row throughout and no aggregation over citations is needed. Citations that aren't looked up have keys of
their own that no record has, so they are spread over all tasks. Spark broadcasts an index that its own size check admits.
A key's array is as long as the key has records: candidates of one citation are part of its row in this data model.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions.columns import let
from attestra.operators import catalog


@dataclass(frozen=True)
class Rules:
    """What the decision may use beyond cardinality.

    judge: answers by the candidates' sorted ids joined with commas, or the table (ids, choice, and trecho if answers differ
    by excerpt) that judge.judged() gives, which is joined.
    """

    duplicates: bool = False
    score: bool = False
    margin: float = 0.0
    judge: Mapping[str, int] | DataFrame | None = field(default=None)


_PARTS = ("uf", "classe", "classes_compostas", "paragrafo", "inciso", "alinea", "vinculante")


#: What a record is found by: its number, summary or article, which of them that is, and an article's statute.
_KEY = ("_chave", "_by", "_of")


def _key(by: str, what: Column, of: Column) -> Column:
    return F.struct(what.alias("_chave"), F.lit(by).alias("_by"), of.alias("_of"))


def _found_by(records: DataFrame) -> DataFrame:
    """_KEY and r: a row for each number of a ruling, each summary and each article of a statute."""
    record = F.struct("id", "tribunal", "natureza", F.struct(*(f"campos.{n}" for n in _PARTS)).alias("campos"), "hash_texto").alias("r")
    law, c, none = catalog.laws(records), F.col("campos"), F.lit("")
    rows = catalog.keys(records).select(_key("n", F.col("chave"), none).alias("k"), record)
    rows = rows.union(law.where(c["sumula"].isNotNull()).select(_key("s", c["sumula"], none), record))
    rows = rows.union(law.where(c["artigo"].isNotNull() & c["diploma"].isNotNull()).select(_key("a", c["artigo"], c["diploma"]), record))
    return rows.select("k.*", "r")


def route(known: Column, kind: Column, campos: Column) -> Column:
    """metodo_busca: how a citation is looked up, if at all."""
    by_law = (kind == "lei") | campos["sumula"].isNotNull()
    some = campos["numero_normalizado"].isNotNull() & (campos["numero_normalizado"] != "")
    return F.when(~known | campos.isNull(), "sem_busca").when(by_law, "lei_sumula").when(some, "catalogo").otherwise("sem_busca")


def law_score(asked: Column, record: Column, court: Column) -> Column:
    """1 or 0.5 for a summary (whether both bind), 1 less 0.3 for each part that both name and that differs for a law; 0 for another court's."""
    courts = F.coalesce(asked["tribunal"] != court, F.lit(False))
    summary = F.when(courts, 0.0).when(asked["vinculante"] != record["vinculante"], 0.5).otherwise(1.0)
    law = F.lit(1.0)
    for part in ("paragrafo", "inciso", "alinea"):
        law = law - F.when(F.coalesce(asked[part] != record[part], F.lit(False)), 0.3).otherwise(0.0)
    return F.when(asked["sumula"].isNotNull(), summary).otherwise(F.greatest(law, F.lit(0.0)))


def _differs(name: str, a: Column, b: Column) -> Column:
    """An array of the name if both are given and differ, or else an empty one."""
    return F.when((a != b) & (a != "") & (b != ""), F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))


def candidate(asked: Column, record: Column, score: Column) -> Column:
    return F.struct(
        record["id"].alias("id"), record["tribunal"].alias("tribunal"), record["natureza"].alias("natureza"), score.alias("score"),
        _differs("uf", asked["uf"], record["campos"]["uf"]).alias("conflitos_duros"),
        F.concat(_differs("tribunal", asked["tribunal"], record["tribunal"]), _differs("classe", asked["classe"], record["campos"]["classe"])).alias("divergencias_brandas"),
        record["campos"]["classes_compostas"].alias("classes_compostas"), record["hash_texto"].alias("hash_texto"),
    )


def _asked(citations: DataFrame) -> DataFrame:
    """citations with metodo_busca and the _KEY that they are looked up by."""
    c = F.col("campos")
    asked = citations.withColumn("metodo_busca", route(F.col("tem_identificador"), F.col("tipo_bruto"), c))
    how, none = F.col("metodo_busca"), F.lit("")
    own = F.xxhash64(*(name for name, kind in citations.dtypes if "map<" not in kind)).cast("string")
    known = (
        F.when(how == "catalogo", _key("n", c["numero_normalizado"], none))
        .when((how == "lei_sumula") & c["sumula"].isNotNull(), _key("s", c["sumula"], none))
        .when((how == "lei_sumula") & c["artigo"].isNotNull() & c["diploma"].isNotNull(), _key("a", c["artigo"], c["diploma"]))
        .otherwise(_key("-", own, none))
    )
    return asked.withColumn("_k", known).select(*asked.columns, "_k.*")


def _score(asked: Column, record: Column) -> Column:
    return F.when(F.col("metodo_busca") == "catalogo", 1.0).otherwise(law_score(asked, record["campos"], record["tribunal"]))


def search(citations: DataFrame, records: DataFrame) -> DataFrame:
    """citations (tipo_bruto, tem_identificador, campos) with metodo_busca and candidatos, best score first, then smaller id."""
    asked, c = _asked(citations), F.col("campos")
    index = _found_by(records).groupBy(*_KEY).agg(F.sort_array(F.collect_list("r")).alias("_records"))
    found = asked.join(index, list(_KEY), "left")
    every = F.coalesce("_records", F.array().cast(index.schema["_records"].dataType))
    scored = F.transform(every, lambda r: F.struct((-_score(c, r)).alias("s"), r["id"].alias("i"), candidate(c, r, _score(c, r)).alias("k")))
    ranked = F.transform(F.sort_array(F.filter(scored, lambda x: x["s"] < 0)), lambda x: x["k"])
    return found.select(*(n for n in asked.columns if n not in _KEY), ranked.alias("candidatos"))


def pairs(citations: DataFrame, records: DataFrame) -> DataFrame:
    """What exploding search()'s candidatos gives, in any order: a row for each citation and candidate, the latter as k.

    No row holds a key's records here, so memory doesn't grow with the records or citations of one key.
    """
    asked, c, r = _asked(citations), F.col("campos"), F.col("r")
    found = _found_by(records).join(asked, list(_KEY)).withColumn("_s", _score(c, r)).where("_s > 0")
    return found.select(*(n for n in asked.columns if n not in _KEY), candidate(c, r, F.col("_s")).alias("k"))


def _answered(rows: DataFrame, judge: Mapping[str, int] | DataFrame) -> DataFrame:
    """Adds _choice: the judge's answer for the candidates of those rows that it is asked about."""
    if not isinstance(judge, DataFrame):
        judge = rows.sparkSession.createDataFrame(list(judge.items()), "ids string, choice bigint")
    by_excerpt = "trecho" in judge.columns and "trecho" in rows.columns
    answers = judge.select(F.col("ids").alias("_ids"), F.col("choice").alias("_choice"), *([F.col("trecho").alias("_excerpt")] if by_excerpt else []))
    # rows that it isn't asked about have a key of their own that no answer has
    key = F.when(F.col("metodo_decisao") == "juiz", F.col("_asked")).otherwise(F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string")))
    same = F.col("_asked") == F.col("_ids")
    return rows.withColumn("_asked", key).join(answers, same & (F.col("trecho") == F.col("_excerpt")) if by_excerpt else same, "left")


def _verdict(rules: Rules) -> Column:
    """metodo, chosen (id and natureza) and, for a judge, kept (those that it chooses from).

    One expression that names each step once: as columns of their own the steps would be written out again within each
    other when a filter moves below them. Repeated ids and texts are found by sorting, not by comparing all pairs.
    """
    classes = F.coalesce(F.col("campos.classes_compostas"), F.array().cast("array<string>"))
    first = lambda of: F.get(of, F.lit(0))
    short = lambda k: F.struct(k["id"].alias("id"), k["natureza"].alias("natureza"))

    def last_of_ids(clean: Column) -> Column:
        """By id; of rows that repeat an id the last one stands, with the best score of them all."""
        by_id = F.sort_array(F.transform(clean, lambda k, at: F.struct(k["id"].alias("id"), at.alias("at"), k.alias("k"))))
        one = lambda rows: F.filter(rows, lambda x, at: ~F.coalesce(F.get(rows, at + 1)["id"] == x["id"], F.lit(False)))
        last = let(by_id, lambda rows: F.transform(one(rows), lambda x: x["k"]))
        if not rules.score:
            return F.transform(last, lambda k: F.struct(F.lit(0.0).alias("s"), k["id"].alias("id"), k.alias("k")))
        scores = F.sort_array(F.transform(clean, lambda k: F.struct(k["id"].alias("id"), k["score"].alias("score"))))
        return let(let(scores, one), lambda top: F.transform(last, lambda k, at: F.struct((-F.get(top, at)["score"]).alias("s"), k["id"].alias("id"), k.alias("k"))))

    def without_copies(one: Column) -> Column:
        """Of records with one text that with the smallest id."""
        by_text = F.sort_array(F.transform(one, lambda x: F.struct(x["k"]["hash_texto"].alias("h"), x["id"].alias("id"), x.alias("x"))))
        firsts = lambda rows: F.filter(rows, lambda r, at: r["h"].isNull() | (at == 0) | ~F.get(rows, at - 1)["h"].eqNullSafe(r["h"]))
        return let(by_text, lambda rows: F.transform(firsts(rows), lambda r: r["x"]))

    def settled(cands: Column, clean: Column, one: Column, kept: Column, same: Column, best: Column) -> Column:
        lead = F.get(best, F.lit(1))["s"] - first(best)["s"]
        by = lambda name, chosen: F.struct(F.lit(name).alias("metodo"), chosen.alias("chosen"))
        nothing = F.lit(None).cast("struct<id:bigint,natureza:string>")
        pick = lambda x: short(x["k"]).cast("struct<id:bigint,natureza:string>")
        out = (
            F.when(F.col("metodo_busca").isNull() | (F.col("metodo_busca") == "sem_busca"), by("sem_identificador", nothing))
            .when((F.size(cands) > 0) & (F.size(clean) == 0), by("veto_quimera", nothing))
            .when(F.size(one) == 0, by("cardinalidade_0", nothing))
            .when(F.size(one) == 1, by("cardinalidade_1", pick(first(one))))
            .when(F.size(kept) == 1, by("desempate_duplicata", pick(first(kept))))
            .when(F.size(same) == 1, by("desempate_classe", pick(first(same))))
        )
        if rules.score:
            out = out.when((lead > 0) & (lead >= rules.margin), by("desempate_score", pick(first(best))))
        return out.otherwise(by("cardinalidade_2mais" if rules.judge is None else "juiz", nothing))

    def of_kept(cands: Column, clean: Column, one: Column, kept: Column) -> Column:
        same = F.filter(kept, lambda x: (F.size(classes) > 0) & (x["k"]["classes_compostas"] == classes))
        best = F.sort_array(kept) if rules.score else kept
        out = let(same, lambda s: let(best, lambda b: settled(cands, clean, one, kept, s, b)))
        return out if rules.judge is None else let(out, lambda o: F.struct(o["metodo"].alias("metodo"), o["chosen"].alias("chosen"), F.sort_array(F.transform(kept, lambda x: short(x["k"]))).alias("kept")))

    def of_all(cands: Column) -> Column:
        clean = F.filter(cands, lambda k: F.size(k["conflitos_duros"]) == 0)
        return let(clean, lambda c: let(last_of_ids(c), lambda one: let(without_copies(one) if rules.duplicates else one, lambda kept: of_kept(cands, c, one, kept))))

    return let(F.col("candidatos"), of_all)


def decide(found: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Adds classificacao, id_canonico, tipo and metodo_decisao, by the number of candidates without a hard conflict."""
    # a generator of one row, over a column: a filter on the verdict stays above it, where it would have it worked out again
    # below; outer, as else a filter for empty arrays is put below it; an expression's type is worked out for each row there
    rows = found.withColumn("_vs", F.array(_verdict(rules))).withColumn("_v", F.explode_outer("_vs")).withColumn("metodo_decisao", F.col("_v.metodo"))
    m, chosen = F.col("metodo_decisao"), F.col("_v.chosen")
    if rules.judge is not None:
        rows = _answered(rows.withColumn("_asked", F.array_join(F.transform("_v.kept", lambda k: k["id"].cast("string")), ",")), rules.judge)
        judged = F.get(F.filter("_v.kept", lambda k: k["id"] == F.col("_choice")), F.lit(0))
        chosen = F.when(m == "juiz", judged).otherwise(chosen)
    rows = rows.withColumn("_chosen", chosen)
    real = F.col("_chosen").isNotNull()
    label = F.when(real, "real").when(m.isin("veto_quimera", "cardinalidade_0"), "inventada").otherwise("incompleta")
    kind = F.when(real & (F.col("_chosen.natureza") == "dispositivo"), "lei").when(real | (F.coalesce("tipo_bruto", F.lit("indefinido")) == "indefinido"), "jurisprudencia").otherwise(F.col("tipo_bruto"))
    return rows.select(*found.columns, label.alias("classificacao"), F.col("_chosen.id").alias("id_canonico"), kind.alias("tipo"), "metodo_decisao")


def calibrate(decided: DataFrame, table: DataFrame | None) -> DataFrame:
    """Adds confianca from table(level, key, confianca): the fine band, or the coarse one, or the default, within 0 to 1."""
    if table is None:
        return decided.withColumn("confianca", F.lit(None).cast("double"))
    one = lambda level: table.where(F.col("level") == level).select(F.col("key").alias(f"_{level}"), F.col("confianca").alias(f"_v_{level}"))
    method, how = F.coalesce("metodo_decisao", F.lit("-")), F.coalesce("metodo_busca", F.lit("-"))
    rows = decided.withColumns({"_kf": F.concat_ws("|", method, how), "_kc": method, "_kd": F.lit("")})
    rows = rows.join(one("fine"), F.col("_kf") == F.col("_fine"), "left").join(one("coarse"), F.col("_kc") == F.col("_coarse"), "left").join(one("default"), F.col("_kd") == F.col("_default"), "left")
    value = F.coalesce("_v_fine", "_v_coarse", "_v_default")
    return rows.select(*decided.columns, F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))).alias("confianca"))
