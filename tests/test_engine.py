"""The engine end to end over inline texts and a small SQLite catalogue."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from attestra.functions import columns as K
from attestra.operators import catalog, checks, emit, fit, judge, metric, resolve, spans
from attestra.plans import pipeline, schemas
from attestra.sources import readers
from attestra.sources.sqlite_source import SqliteSource

RECORDS = [
    ("d1", 5665364632, "STM", 2023, "R", "acordao", "jurisprudencia", "APELAÇÃO Nº 7000449-40.2023.7.00.0000/RS\nEMENTA x"),
    ("d2", 1111111111, "STJ", 2012, "R", "acordao", "jurisprudencia", "RECURSO ESPECIAL Nº 1.307.026 - BA (2012/0012345-6)\nEMENTA x"),
    ("d3", 900045, "STF", 2010, None, "sumula", "jurisprudencia", "Súmula Vinculante 45"),
    ("d4", 900331, "TST", 2010, None, "sumula", "jurisprudencia", "Súmula nº 331 do TST"),
    ("d5", 800927, None, 2015, None, "dispositivo", "lei", "Art. 927. Os juízes observarão, no Código de Processo Civil"),
    ("d6", 7, "STJ", 2015, None, "acordao", "jurisprudencia", "AgInt no REsp Nº 1.597.443\nEMENTA a"),
    ("d7", 8, "STJ", 2016, None, "acordao", "jurisprudencia", "AgInt nos EREsp Nº 1.597.443\nEMENTA b"),
]
TEXT = "Conforme o RESP n. 1\n307\n026/BA e a Súmula 331 do TST, bem como a Súmula Vinculante 45 e o art. 927 do CPC; e ainda o HC 123.456, o AgInt no REsp 1.597.443 e o julgado do STF proferido em 2024 pela relatoria de Dias Toffoli, no ponto."


@pytest.fixture(scope="module")
def records(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("db") / "base.db"
    with sqlite3.connect(path) as c:
        c.execute("create table documentos (documento_id text, id integer, tribunal text, ano integer, relator text, natureza text, tipo text, texto text)")
        c.executemany("insert into documentos values (?,?,?,?,?,?,?,?)", RECORDS)
    spark.dataSource.register(SqliteSource)
    source = spark.read.format("sqlite").option("path", str(path)).load()
    out = str(tmp_path_factory.mktemp("catalog") / "c")
    catalog.save(catalog.build(source), out, readers.fingerprint(str(path)))
    readers.check_fresh(spark, out, readers.fingerprint(str(path)))
    with pytest.raises(ValueError):
        readers.check_fresh(spark, out, "other")
    return catalog.load(spark, out)


def test_catalog(records):
    found = {r["id"]: r for r in records.collect()}
    assert found[5665364632]["campos"]["numero_normalizado"] == "70004494020237000000"
    assert found[1111111111]["campos"]["numero_normalizado"] == "1307026"
    assert found[900045]["campos"]["vinculante"] and found[900331]["campos"]["sumula"] == "331"
    assert found[800927]["campos"]["artigo"] == "927" and found[800927]["campos"]["diploma"] == "CPC"
    assert catalog.collision_report(catalog.keys(records)) == "1597443: ids [7, 8]"


def test_run(spark, records, tmp_path):
    docs = spark.createDataFrame([("a", TEXT), ("b", ""), ("c", None), ("e", "nada aqui")], "documento_id string, texto string")
    decided = pipeline.run(docs, records)
    rows = {r["trecho"].split()[0] + "/" + r["trecho"].split()[-1]: r for r in decided.collect()}
    got = {k: (r["classificacao"], r["metodo_decisao"], r["id_canonico"]) for k, r in rows.items()}
    assert got == {
        "RESP/026/BA": ("real", "cardinalidade_1", 1111111111),
        "Súmula/TST": ("real", "cardinalidade_1", 900331),
        "Súmula/45": ("real", "cardinalidade_1", 900045),
        "art./CPC": ("real", "cardinalidade_1", 800927),
        "HC/123.456": ("inventada", "cardinalidade_0", None),
        "AgInt/1.597.443": ("real", "desempate_classe", 7),
        "julgado/Toffoli": ("incompleta", "sem_identificador", None),
    }
    out = emit.documents(docs, decided)
    cells = {r[0]: r[1] for r in emit.submission(out).collect()}
    assert cells["b"] == cells["c"] == "-" and cells["a"].count("|") == 6
    assert checks.violations(docs, decided, emit.submission(out)).count() == 0
    made = json.loads(emit.as_json(out).where("documento_id = 'a'").first()["json"])
    assert "confianca" not in made["citacoes"][0] and made["citacoes"][0]["resolucao"]["id_canonico"] == 1111111111
    emit.write_trace(decided, str(tmp_path / "trace"))
    assert readers.trace(spark, str(tmp_path / "trace")).count() == 7


def test_gold_as_submission_scores_the_most(spark):
    cells = [("a", 1, "0,10,real,00012:7|20,30,inventada,-"), ("b", 2, "5,9,incompleta,-"), ("c", 2, "-")]
    solution = spark.createDataFrame(cells, schemas.SOLUTION.names)
    solution = solution.withColumn("nivel", F.col("nivel").cast("int"))
    sent = spark.createDataFrame([("a", "0,10,real,12,1.0|20,30,inventada,-,1.0"), ("b", "5,9,incompleta,-,1"), ("c", "-")], schemas.SUBMISSION)
    levels = metric.evaluate(solution, sent)
    assert metric.final_score(levels).first()["final"] == pytest.approx(1.1)
    with pytest.raises(metric.SubmissionError, match="real without an id"):
        metric.evaluate(solution, sent.union(spark.createDataFrame([("d", "0,3,real,-,-")], schemas.SUBMISSION)))
    with pytest.raises(metric.SubmissionError, match="not sent"):
        metric.evaluate(solution, sent.where("documento_id <> 'b'"))


def test_matching_and_spare_predictions(spark):
    solution = spark.createDataFrame([("a", 1, "0,5,inventada,-|5,10,inventada,-|40,60,real,9")], "documento_id string, nivel int, citacoes string")
    sent = spark.createDataFrame([("a", "0,10,inventada,-,-|40,60,real,8,0.5|42,44,real,9,-|90,95,real,9,-")], schemas.SUBMISSION)
    rows = metric.aligned(solution, sent)
    assert [(u["g"], u["p"]) for u in rows.first()["pairs"]] == [(2, 1), (0, 0)]
    found = {r["classe"]: r for r in metric.confusion(metric.events(rows)).collect()}
    assert (found["real"]["tp"], found["real"]["fp"], found["real"]["fn"]) == (0, 2, 0)
    assert (found["inventada"]["tp"], found["inventada"]["fn"]) == (1, 1)


def test_fit(spark):
    rows = [("a", "m", "x", 1)] * 8 + [("b", "m", "y", 0)] * 2 + [("b", "m", "x", 0)]
    labelled = spark.createDataFrame(rows, "documento_id string, metodo_decisao string, metodo_busca string, hit int")
    bands = {(r["level"], r["key"]): r["confianca"] for r in fit.table(labelled).collect()}
    assert bands["fine", "m|y"] == 0.25 and bands["coarse", "m"] == round(9 / 13, 4) and bands["default", ""] == round(9 / 13, 4)

    def without(doc):
        rest = [r for r in rows if r[0] != doc]
        share = lambda s: round((sum(r[3] for r in s) + 1) / (len(s) + 2), 4)
        return lambda r: share([s for s in rest if s[1:3] == r[1:3]] or [s for s in rest if s[1] == r[1]] or rest)

    expect = sum((without(r[0])(r) - r[3]) ** 2 for r in rows) / len(rows)
    assert fit.leave_one_out(labelled).first()["brier"] == pytest.approx(expect)
    assert json.loads(fit.as_json(fit.table(labelled)))["faixas"]["m|x"]["total"] == 9


def test_greedy_deduplication(spark):
    row = lambda a, b, o="regex_camada1": (a, b, "x", "lei", True, o)
    df = spark.createDataFrame([([row(0, 10), row(2, 8), row(9, 20), row(0, 30, "heuristica_camada2"), row(40, 50, "heuristica_camada2")],)], f"s array<{schemas.CANDIDATE_SPAN.simpleString()}>")
    kept = df.select(spans.without_overlaps(F.col("s")).alias("s")).first()["s"]
    assert [(s["inicio"], s["fim"]) for s in kept] == [(9, 20), (0, 10), (0, 30), (40, 50)]


@pytest.mark.parametrize("reply,expect", [('```json\n{"id_canonico": 2}\n```', 2), ('so: {"id_canonico": "2"} ok', 2), ("", None), ("[2]", None), ('{"id_canonico": true}', None), ('{"id_canonico": 9}', None), ('{"id_canonico": 2', None)])
def test_judge(reply, expect):
    assert judge.valid(judge.parsed(reply), [1, 2]) == expect


def test_tie_breaks(spark):
    def decided(cands, rules=resolve.Rules(), how="catalogo"):
        kind = "array<struct<id:bigint,tribunal:string,natureza:string,score:double,conflitos_duros:array<string>,divergencias_brandas:array<string>,classes_compostas:array<string>,hash_texto:string>>"
        rows = [(how, "jurisprudencia", (["REsp"],), [(i, "STJ", "acordao", s, c, [], k, h) for i, s, c, k, h in cands])]
        df = spark.createDataFrame(rows, f"metodo_busca string, tipo_bruto string, campos struct<classes_compostas:array<string>>, candidatos {kind}")
        r = resolve.decide(df, rules).first()
        return r["classificacao"], r["metodo_decisao"], r["id_canonico"]

    a, b = (1, 1.0, [], ["AgInt"], "h"), (2, 0.7, [], ["EDcl"], "h")
    assert decided([a], how=None) == ("incompleta", "sem_identificador", None)
    assert decided([]) == ("inventada", "cardinalidade_0", None)
    assert decided([(1, 1.0, ["uf"], [], None)]) == ("inventada", "veto_quimera", None)
    assert decided([a, a]) == ("real", "cardinalidade_1", 1)
    assert decided([a, b]) == ("incompleta", "cardinalidade_2mais", None)
    assert decided([a, b], resolve.Rules(duplicates=True)) == ("real", "desempate_duplicata", 1)
    assert decided([a, (3, 1.0, [], ["REsp"], None)]) == ("real", "desempate_classe", 3)
    assert decided([a, b], resolve.Rules(score=True)) == ("real", "desempate_score", 1)
    assert decided([a, b], resolve.Rules(score=True, margin=0.5)) == ("incompleta", "cardinalidade_2mais", None)
    assert decided([a, b], resolve.Rules(judge={"1,2": 2})) == ("real", "juiz", 2)
    assert decided([a, b], resolve.Rules(judge={"1,2": 5})) == ("incompleta", "juiz", None)


def test_native_columns(spark):
    df = spark.createDataFrame([("1234567",), ("70004494020237000000",), ("12",), (None,)], "d string")
    assert [r[0] for r in df.select(K.regrouped("d")).collect()] == ["1.234.567", "7000449-40.2023.7.00.0000", "12", None]
    texts = ["a\n\nb", "x EMENTA y", "Processo nº 5\nfim", "q" * 2000, "", "ação PROCESSO Nº 1"]
    from attestra.functions.keys import header_end

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(K.header_end("t")).collect()] == [header_end(t) for t in texts]


def test_harness_slices_are_exact(spark):
    from attestra.operators import harness

    decided = harness.run(spark, spark.range(1, 4).withColumn("id", F.col("id") * 100))
    assert harness.inexact(decided).count() == 0 and decided.count() == 3 * len(harness.SLICES)
    assert {r[0] for r in decided.select(harness.error_rows(decided)).collect()} == {"acerto"}
    assert harness.scores(decided).first()["score"] == pytest.approx(1.0)
    assert harness.inexact(harness.without(decided, ["desempate_classe"])).count() == 3
    assert harness.scores(harness.projected(decided, False)).first()["macro_f1"] < 1
    assert harness.judge_precision(harness.run(spark, spark.range(1), resolve.Rules(judge={"0,1": 0}))).first()["asked"] == 2
    assert harness.diagnostics(decided).agg(F.sum("count")).first()[0] == decided.count()


def test_no_confidence_gives_no_bonus_and_no_table_no_confidence(spark):
    solution = spark.createDataFrame([("a", 1, "0,10,real,12")], "documento_id string, nivel int, citacoes string")
    sent = spark.createDataFrame([("a", "0,10,real,12,-")], schemas.SUBMISSION)
    row = metric.evaluate(solution, sent).first()
    assert (row["bonus"], row["score"]) == (0.0, 1.0)
    decided = spark.createDataFrame([("m", None), (None, "x")], "metodo_decisao string, metodo_busca string")
    table = spark.createDataFrame([("fine", "m|-", 1.7), ("coarse", "-", -0.2)], "level string, key string, confianca double")
    assert [r["confianca"] for r in resolve.calibrate(decided, table).collect()] == [1.0, 0.0]
    assert {r["confianca"] for r in resolve.calibrate(decided, table.limit(0)).collect()} == {None}


def test_ids_of_any_size_are_in_order(spark):
    from attestra.plans.derived import campos

    ids = [5665364632, 10577194, 9_000_000_000_000_000_000, 7]
    records = spark.createDataFrame([(i,) for i in ids], "id long")
    null = F.lit(None).cast("string")
    records = records.select("id", null.alias("tribunal"), F.lit("acordao").alias("natureza"), campos(numero_normalizado=F.lit("1234567"), classes_compostas=F.array()).alias("campos"), null.alias("hash_texto"), F.array().cast("array<string>").alias("numeros_alternativos"))
    asked = spark.range(2).select("id", F.lit("jurisprudencia").alias("tipo_bruto"), (F.col("id") == 0).alias("tem_identificador"), campos(numero_normalizado=F.lit("1234567")).alias("campos"))
    got = {r["id"]: [k["id"] for k in r["candidatos"]] for r in resolve.search(asked, records).collect()}
    assert got == {0: sorted(ids), 1: []}


def test_the_first_row_sent_for_a_document_counts(spark):
    solution = spark.createDataFrame([("a", 1, "0,10,real,12")], "documento_id string, nivel int, citacoes string")
    sent = spark.createDataFrame([("a", "0,10,real,12,1.0"), ("a", "-"), ("a", "0,x")], schemas.SUBMISSION)
    assert metric.final_score(metric.evaluate(solution, sent)).first()["final"] == pytest.approx(1.1)
    turned = sent.withColumn("linha", F.when(F.col("citacoes") == "-", 1).otherwise(2))
    assert metric.evaluate(solution, turned).first()["macro_f1"] == 0


_IDENTIFIED = [
    ("EDcl no AgInt no ARESP  1 821 663/ SC", None), ("RESP n. 1\n307\n026/BA", None), ("Primeiro AgRg no RE 597.443 (SP)", None), ("REsp\xa01.597.443", None),
    ("H.C. 1.45g.779", None), ("5úmula 331 do TST", None), ("Temã 1.046 da repercussão geral", None), ("TST-ED-E-ED-RR-3400-05.2011.5.21.0009", None),
    ("7OOO449-40.2023.7.00.0000/RS", None), ("REsp 1.597.443/XX", "REsp 1.597.443"), ("REsp 1.597.443\n\n002", "REsp 1.597.443"), ("art. 5º, § 3º, da CF", None),
    ("AgInt no REsp 7000449-40.2023.7.00.0000", None),
]


@pytest.mark.parametrize("text,expect", _IDENTIFIED)
def test_spans_with_identifiers(spark, text, expect):
    docs = spark.createDataFrame([("d", "x\n\n" + "palavra " * 10 + text + ", fim")], "documento_id string, texto string")
    assert [(r["trecho"], r["tem_identificador"]) for r in spans.extract(docs).collect()] == [(expect or text, True)]


@pytest.mark.parametrize("text,known", [("acórdão do STF de 2019, Rel. Min. Ana D’Ávila", True), ("AgRg no HC julgado em 1999 sob relatoria do Juiz Bento dos Santos", True), ("decisão de 2024\n\npela relatoria de Ana", False), ("julgado de 2024; relatoria de Ana", False), ("julgado de 12 de 2024 pela relatoria de Ana", False)])
def test_spans_without_identifiers(text, known):
    from attestra.functions.citation_spans import candidates

    found = [(t, k) for _, _, t, _, k, _ in candidates("Veja o " + text + " e mais.")]
    assert found == ([(text, False)] if known else [])


def test_own_number_cases():
    from attestra.functions.own_number import own_numbers

    far = "Lei nº 13.467/2017\n" + "texto " * 250 + "discutidos estes autos de Recurso de Revista nº TST-RR-34000-52.2011.5.21.0009, em que"
    assert own_numbers(far, "TST") == ["340005220115210009"]
    assert own_numbers("RECURSO Nº 2883 (2012/0012345-6) RJ12345\nEMENTA", "STJ") == ["2883"]
    assert own_numbers("12/05/2010 PRIMEIRA TURMA HC 76.532 origem 0012345-67.2009.8.26.0000", "STF") == ["76532"]
    assert own_numbers("RESPE Nº 1662 (47142-16.2008.6.00.0000) - PI", "TSE") == ["1662", "471421620086000000"]
    assert own_numbers("em 2010", "STF") == own_numbers(None, None) == own_numbers("", "TST") == []


@pytest.mark.parametrize("text,chain", [("EDcl no AgInt no ARESP", ["EDcl", "AgInt", "AREsp"]), ("AgInt nosEMBARGOS DE DIVERGÊNCIA EM RESP", ["AgInt", "EREsp", "REsp"]), ("", []), ("R. Esp. e rec. esp.", ["REsp", "REsp"])])
def test_class_names(text, chain):
    from attestra.functions.keys import names

    assert names(text, "class") == chain


def test_key_properties():
    import random

    from attestra.functions import keys
    from attestra.functions.citation_spans import noisy

    rng = random.Random(5)
    for _ in range(300):
        digits = "2" + "".join(rng.choices("0123456789", k=rng.choice((5, 6, 9, 19))))
        shown = keys.regroup(digits)
        assert keys.digit_key(shown) == (digits, False) and keys.repair(keys.repair(shown)[0]) == (shown, False)
        spoiled = noisy("REsp 2345." + shown, rng.randrange(1 << 30))
        assert keys.digit_key(spoiled)[0] == "2345" + digits
        assert keys.signature(keys.signature(shown)) == keys.signature(shown)


def test_judge_is_asked_once_for_each_excerpt(spark):
    asked = spark.createDataFrame([("a", [(2,), (1,)]), ("a", [(1,), (2,)]), ("b", [(1,), (2,)]), ("c", [(1,)])], "trecho string, candidatos array<struct<id:bigint>>")
    said = judge.judged(asked, judge.Scripted(lambda p: '{"id_canonico": 1, "justificativa": "r"}' if "Citation: a" in p else "no")).collect()
    assert sorted((r["trecho"], r["ids"], r["choice"], r["reason"]) for r in said) == [("a", "1,2", 1, "r"), ("b", "1,2", None, None)]


def test_sources_and_command_line(spark, records, tmp_path, monkeypatch, capsys):
    from attestra.plans import cli
    from attestra.streaming import folder

    monkeypatch.setattr(spark, "stop", lambda: None)
    texts = tmp_path / "texts"
    texts.mkdir()
    (texts / "um.txt").write_bytes(TEXT.replace(", b", ",\r\nb").encode())
    (texts / "dois.txt").write_text("nada", encoding="utf-8")
    catalog.save(records, str(tmp_path / "catalog"), "0")
    docs = {r["documento_id"]: r["texto"] for r in readers.documents(spark, str(texts)).collect()}
    assert set(docs) == {"um", "dois"} and "\r" not in docs["um"] and "\r\n" in {r["documento_id"]: r["texto"] for r in readers.documents(spark, str(texts), raw=True).collect()}["um"]
    out = tmp_path / "out"
    assert cli.main(["run", str(texts), str(tmp_path / "catalog"), str(out)]) == 0
    lines = (out / "submission.csv").read_text(encoding="utf-8").splitlines()
    assert lines[0] == "documento_id,citacoes" and lines[1].startswith("dois,") and lines[2].count("|") == 6 and len(lines) == 3
    found = readers.trace(spark, str(out / "trace")).orderBy("inicio").collect()
    gold = "\ufeffnivel,documento_id,citacao_id,inicio,fim,trecho,tipo,classificacao,id_canonico\n" + "".join(f"1,um,{k},{r['inicio']},{r['fim']},x\\ny,{'lei'},{r['classificacao']},{r['id_canonico'] or ''}\n" for k, r in enumerate(found))
    (tmp_path / "gold.csv").write_text(gold, encoding="utf-8")
    rows = readers.gold(spark, str(tmp_path / "gold.csv"))
    assert rows.count() == 7 and readers.with_excerpts(rows, spark.createDataFrame([], "documento_id string, texto string")).first()["trecho"] == "x\ny"
    assert cli.main(["fit", str(out / "trace"), str(tmp_path / "gold.csv"), str(tmp_path / "table.json")]) == 0
    bands = {(r["level"], r["key"]): r["confianca"] for r in readers.confidence_table(spark, str(tmp_path / "table.json")).collect()}
    assert bands["default", ""] == round(8 / 9, 4)
    solution = emit.from_gold(rows).union(spark.createDataFrame([("dois", 2, "-")], "documento_id string, nivel int, citacoes string"))
    solution.coalesce(1).write.csv(str(tmp_path / "solution"), header=True)
    assert cli.main(["score", str(tmp_path / "solution"), str(out / "submission.csv"), "--out", str(tmp_path / "scores.json")]) == 0
    assert json.loads((tmp_path / "scores.json").read_text())["final"] == pytest.approx(1.0)
    assert cli.main(["harness", "3"]) == 0 and "inexact: 0" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["run", str(tmp_path / "none"), "x", "y"])
    folder.watch(spark, str(texts), records, str(tmp_path / "stream"), str(tmp_path / "checkpoint")).awaitTermination()
    assert readers.trace(spark, str(tmp_path / "stream" / "batch=0")).count() == 7
    emit.write_document_files(emit.documents(spark.createDataFrame(list(docs.items()), "documento_id string, texto string"), spark.read.parquet(str(out / "citations"))), str(tmp_path / "json"))
    assert sorted(p.name for p in (tmp_path / "json").iterdir()) == ["dois.json", "um.json"] and len(json.loads((tmp_path / "json" / "um.json").read_text())["citacoes"]) == 7


def test_a_key_of_very_many_records_is_decided_in_reasonable_time(spark):
    """Three thousand candidates, each text twice: comparing all pairs again within each pair doesn't end."""
    kind = "array<struct<id:bigint,tribunal:string,natureza:string,score:double,conflitos_duros:array<string>,divergencias_brandas:array<string>,classes_compostas:array<string>,hash_texto:string>>"
    cands = [(i, "STJ", "acordao", 1.0, [], [], ["REsp"], str(i // 2)) for i in range(3000)]
    rows = [("catalogo", "jurisprudencia", (["REsp"],), cands), ("catalogo", "jurisprudencia", (["REsp"],), [(i, *c[1:7], "h") for i, c in enumerate(cands, 5)])]
    df = spark.createDataFrame(rows, f"metodo_busca string, tipo_bruto string, campos struct<classes_compostas:array<string>>, candidatos {kind}")
    decided = resolve.decide(df, resolve.Rules(duplicates=True))
    assert {(r["metodo_decisao"], r["id_canonico"]) for r in decided.collect()} == {("cardinalidade_2mais", None), ("desempate_duplicata", 5)}
    assert decided.where("metodo_decisao = 'desempate_duplicata'").first()["id_canonico"] == 5


def test_digits_are_no_class_beside_letters_nor_within_a_number():
    from attestra.functions.fields import fields

    read = lambda t: fields(t, "jurisprudencia")[0]
    assert [(read(t)["classe"], read(t)["classes_compostas"]) for t in ("RECURSO ESPECIAL Nº 1.000.515\nEMENTA", "5L5 nº 2.345/SP")] == [("REsp", ["REsp"]), ("SLS", ["SLS"])]
    assert [len(read(f"AgRg 1.{n}")["variantes_texto"]) for n in ("000.515", "515.000", "515.515", "234.567")] == [9, 7, 9, 7]


def test_numbers_of_large_keys_are_read_whole(spark, tmp_path):
    """Customer keys from 9,000,000 on make numbers of more than seven digits."""
    from attestra.plans import kernel_queries

    keys = [(2, 8_999_515), (5, 9_000_515), (11, 9_515_234), (17, 14_515_515), (26, 59_000_000), (32, 4_000_000_515)]
    spark.createDataFrame([(o, c, None) for o, c in keys], "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    read = {r["o_orderkey"]: (r["numero"], r["variantes"]) for r in kernel_queries.summary_fields(spark, str(tmp_path)).collect()}
    assert read == {o: (str(1_000_000 + c), 9 if c % 1000 == 515 else 7) for o, c in keys}
    own = {r["o_orderkey"]: r["numeros"] for r in kernel_queries.own_numbers(spark, str(tmp_path)).collect()}
    cnj = lambda o, c: f"{o:07}{c % 100:02}{2000 + o % 20}5{c % 90:02}0001"
    assert own == {o: {0: cnj(o, c), 1: f"{1_000_000 + c},{cnj(o, c)}", 2: str(1_000_000 + c)}[o % 5] for o, c in keys}


def test_pairs_are_the_candidates_without_arrays_of_a_keys_records(spark):
    from attestra.plans.derived import campos

    law = lambda three: campos(artigo=F.lit("5"), diploma=F.lit("CF"), paragrafo=three.cast("string"), vinculante=F.lit(False), classes_compostas=F.array())
    null = F.lit(None).cast("string")
    records = spark.range(6).select("id", null.alias("tribunal"), F.lit("dispositivo").alias("natureza"), law(F.col("id") % 3).alias("campos"), null.alias("hash_texto"), F.array().cast("array<string>").alias("numeros_alternativos"))
    asked = spark.range(4).select(F.col("id").alias("n"), F.lit("lei").alias("tipo_bruto"), (F.col("id") > 0).alias("tem_identificador"), law(F.col("id") % 3).alias("campos"))
    rows = lambda df: sorted((r["n"], r["k"]["id"], r["k"]["score"]) for r in df.collect())
    found = resolve.pairs(asked, records)
    assert len(rows(found)) == 18 and rows(found) == rows(resolve.search(asked, records).select("n", F.explode("candidatos").alias("k")))
    assert "collect_list" not in found._jdf.queryExecution().toString()


def test_spare_predictions_that_count_take_one_matching(spark, sf_dir):
    from attestra.plans import registry

    plans = [registry.extra_rule(spark, sf_dir), registry.error_category(spark, sf_dir), registry.regression_gate(spark, sf_dir)]
    assert [df._jdf.queryExecution().optimizedPlan().toString().count("Window [") for df in plans] == [2, 2, 2]


def test_spans_are_searched_once_and_put_in_order_once(spark):
    docs = spark.createDataFrame([("a", TEXT), ("b", "nada aqui"), ("c", None)], "documento_id string, texto string").repartition(2)
    found = spans.extract(docs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert (plan.count("ArrowEvalPython ["), plan.count("sort_array(") + plan.count("array_sort(")) == (1, 1)
    assert {r["documento_id"] for r in found.collect()} == {"a"}


def test_decisions_and_problems_are_worked_out_once(spark, sf_dir):
    from attestra.plans import kernel_queries, registry

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(registry.tiebreak_class(spark, sf_dir)).count("veto_quimera") == 1
    assert plan(registry.cell_problems(spark, sf_dir)).count("overlaps an earlier citation") == 1
    # lines are dealt by order, and cells by document: no third deal between them
    assert plan(registry.parse_cell(spark, sf_dir)).count("Aggregate [l_orderkey") == 1
    asked = plan(judge.judged(kernel_queries._undecided(spark, sf_dir), judge.Scripted(str)))
    assert "classes_compostas" in asked and "conflitos_duros" not in asked.split("MapInArrow", 1)[1].split("Aggregate", 1)[0]
