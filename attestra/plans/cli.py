"""python -m attestra.plans.cli: build a catalogue, run documents, score a submission, fit confidences, try the decision."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from attestra.operators import catalog, checks, emit, fit, harness, metric
from attestra.plans import pipeline, schemas
from attestra.sources import readers
from attestra.sources.sqlite_source import SqliteSource


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    steps = p.add_subparsers(dest="step", required=True)
    build = steps.add_parser("catalog")
    build.add_argument("database"), build.add_argument("out")
    run = steps.add_parser("run")
    run.add_argument("texts"), run.add_argument("catalog"), run.add_argument("out")
    run.add_argument("--database"), run.add_argument("--confidence")
    score = steps.add_parser("score")
    score.add_argument("solution"), score.add_argument("submission"), score.add_argument("--before"), score.add_argument("--out")
    fitted = steps.add_parser("fit", help="a confidence table from a run's trace and the gold")
    fitted.add_argument("trace"), fitted.add_argument("gold"), fitted.add_argument("out")
    tried = steps.add_parser("harness", help="the decision alone, on generated slices")
    tried.add_argument("bases", type=int), tried.add_argument("--out")
    return p


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    for name in ("database", "texts", "catalog", "solution", "submission", "confidence", "trace", "gold"):
        if (path := getattr(args, name, None)) and "://" not in path and not Path(path).exists():
            raise SystemExit(f"no such file or folder: {path}")
    spark = SparkSession.builder.appName("attestra").getOrCreate()
    if args.step == "catalog":
        spark.dataSource.register(SqliteSource)
        source = spark.read.format("sqlite").option("path", args.database).load()
        catalog.save(catalog.build(source), args.out, readers.fingerprint(args.database))
    elif args.step == "run":
        if args.database:
            readers.check_fresh(spark, args.catalog, readers.fingerprint(args.database))
        docs = readers.documents(spark, args.texts)
        table = readers.confidence_table(spark, args.confidence) if args.confidence else None
        decided = pipeline.run(docs, catalog.load(spark, args.catalog), table)
        # written once and read again, so that texts are searched once
        decided.write.mode("overwrite").parquet(f"{args.out}/citations")
        decided = spark.read.parquet(f"{args.out}/citations")
        emit.write_trace(decided, f"{args.out}/trace")
        rows = emit.documents(docs, decided)
        emit.write_documents(rows, f"{args.out}/documents")
        cells = emit.submission(rows)
        emit.write_submission(cells, f"{args.out}/cells")
        emit.one_file(spark, f"{args.out}/cells", f"{args.out}/submission.csv")
        checks.require(checks.violations(docs, decided, cells))
    elif args.step == "fit":
        labelled = fit.labels(readers.trace(spark, args.trace), readers.gold(spark, args.gold))
        bands = fit.table(labelled)
        Path(args.out).write_text(fit.as_json(bands), encoding="utf-8")
        value = fit.leave_one_out(labelled).first()["brier"]
        print(f"brier in sample {fit.brier(labelled, bands).first()['brier']}, by documents left out {value}")
    elif args.step == "harness":
        decided = harness.run(spark, spark.range(args.bases).select((F.col("id") * 1000).alias("id")))
        harness.scores(decided).show()
        print(f"inexact: {harness.inexact(decided).count()}")
        if args.out:
            rows = decided.select("slice", "base", "metodo_busca", F.size("candidatos").alias("candidates"), "classificacao", "id_canonico", "metodo_decisao", "want_class", "want", "want_method", harness.error_rows(decided).alias("error"))
            rows.where("error <> 'acerto'").write.mode("overwrite").csv(args.out, header=True)
    else:
        solution, sent = (readers.table(spark, path, kind) for path, kind in ((args.solution, schemas.SOLUTION), (args.submission, schemas.SUBMISSION)))
        levels = metric.evaluate(solution, sent)
        levels.show(truncate=False)
        final = metric.final_score(levels)
        final.show()
        if args.out:
            rows = {r["nivel"]: r.asDict() for r in levels.collect()}  # a row for each level
            Path(args.out).write_text(json.dumps({"final": final.first()["final"], "levels": rows}, indent=2), encoding="utf-8")
        if args.before:
            worse = metric.gate(levels, spark.read.json(args.before)).collect()
            print("\n".join(f"warning: level {r['nivel']} is worse than before" for r in worse))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
