"""The catalogue: records with their own identifiers, the key index, the law list, and where keys collide."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions import columns as K
from attestra.functions.fixed_values import STATUTE_BY_ID


def build(source: DataFrame, statutes: Mapping[int, str] = STATUTE_BY_ID) -> DataFrame:
    """source (the eight columns) to records: metadata, campos, hash_texto and numeros_alternativos.

    Fields come from the header alone. A ruling is never a summary and goes by its own numbers; a law record listed in
    statutes (a small parameter) has that statute.
    """
    ruling, law = F.col("natureza") == "acordao", F.col("natureza") == "dispositivo"
    kind = F.when(F.col("tipo") == "lei", "lei").otherwise("jurisprudencia")
    read = source.withColumns({
        "_c": K.parse_fields(F.substring(F.col("texto"), F.lit(1), K.header_end("texto")), kind)["campos"],
        "_own": K.own_numbers(F.when(ruling, F.col("texto")), F.col("tribunal")),
    })
    known = F.create_map(*(F.lit(x) for pair in statutes.items() for x in pair)) if statutes else F.create_map().cast("map<bigint,string>")
    c = F.col("_c")
    as_ruling = (
        c.withField("numero_normalizado", F.get("_own", F.lit(0)))
        .withField("classe", F.when(c["classe"] == "Súmula", F.try_element_at(c["classes_compostas"], F.lit(-1))).otherwise(c["classe"]))
        .withField("sumula", F.lit(None).cast("string"))
        .withField("vinculante", F.lit(False))
    )
    as_law = c.withField("diploma", F.coalesce(F.try_element_at(known, F.col("id")), c["diploma"]))
    campos = F.when(ruling, as_ruling).when(law, as_law).otherwise(c)
    return read.select(
        "id", "documento_id", "natureza", "tipo", "tribunal", "ano", "relator", campos.alias("campos"), F.sha1(F.encode("texto", "UTF-8")).alias("hash_texto"),
        F.when(ruling, F.slice("_own", 2, 100)).otherwise(F.array().cast("array<string>")).alias("numeros_alternativos"),
    )


def keys(records: DataFrame) -> DataFrame:
    """One row for each key of each record that is neither a summary nor a law."""
    every = F.array_distinct(F.array_compact(F.concat(F.array("campos.numero_normalizado"), "numeros_alternativos")))
    rulings = records.where(~F.coalesce(F.col("natureza"), F.lit("")).isin("sumula", "dispositivo"))
    return rulings.select(F.explode(every).alias("chave"), *records.columns)


def laws(records: DataFrame) -> DataFrame:
    return records.where(F.col("natureza").isin("sumula", "dispositivo"))


def collisions(key_rows: DataFrame) -> DataFrame:
    """Keys of more than one record, with their ids in order."""
    return key_rows.groupBy("chave").agg(F.sort_array(F.collect_list("id")).alias("ids")).where(F.size("ids") > 1)


def collision_report(key_rows: DataFrame) -> str:
    """As text, by key. The report is for people and as long as there are collisions."""
    lines = [f"{r['chave']}: ids {r['ids']}" for r in collisions(key_rows).orderBy("chave").toLocalIterator()]
    return "\n".join(lines) or "nenhuma colisão"


def save(records: DataFrame, path: str, sha256: str) -> None:
    """Records as Parquet with a manifest that names the source."""
    records.write.mode("overwrite").parquet(f"{path}/records")
    records.sparkSession.createDataFrame([(sha256,)], "sha256 string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/records")
