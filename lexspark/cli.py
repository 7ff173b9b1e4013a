"""Command line: from a registry and a folder of texts to submissions.

    python -m lexspark.cli submit REGISTRY.db TEXTS OUT [--templates T.json] [--spans S.json] [--gold G.csv --metric M.py] [--calibrated]
    python -m lexspark.cli index REGISTRY.db OUT
    python -m lexspark.cli check JSON TEXTS
    python -m lexspark.cli score JSON GOLD.csv [--metric M.py]

``submit`` writes the variants main, diffuse and, with a tagger's spans, tagged: a
folder of contract files and a submission each, after the contract is checked.
"""

from __future__ import annotations

import argparse
import csv
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.operators import evaluate, tagger
from lexspark.operators.index import build
from lexspark.plans.verify import contract, submission, verify
from lexspark.shared import written
from lexspark.sources import files


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("lexspark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def problems(docs: DataFrame, folder: str) -> DataFrame:
    """(document_id, problem) of a folder of contract files."""
    spark = docs.sparkSession
    made = evaluate.file_problems(docs, files.read_contract_files(spark, folder))
    inside = evaluate.violations(docs, files.read_contract(spark, folder)).select("document_id", F.concat("citation_id", F.lit(": "), "problem").alias("problem"))
    return made.unionByName(inside)


def _checked(docs: DataFrame, folder: str) -> int:
    found = problems(docs, folder).orderBy("document_id", "problem").limit(60).collect()
    for row in found:
        print(f"  - {row.document_id}: {row.problem}")
    return len(found)


def _csv(rows: DataFrame, path: str) -> None:
    """A submission as one file, streamed through the driver in order."""
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(["documento_id", "citacoes"])
        out.writerows((r.documento_id, r.citacoes) for r in rows.orderBy("documento_id").toLocalIterator())


def submit(a) -> int:
    spark = _session()
    docs = written(files.read_texts(spark, a.texts))
    files.write_index(build(files.read_registry(spark, a.registry)), f"{a.out}/index")
    index = files.read_index(spark, f"{a.out}/index")
    neutral = tuple(files.read_templates(spark, a.templates)["neutral"]) if a.templates else ()
    made = {"main": written(verify(docs, index, False, a.calibrated, neutral)), "diffuse": written(verify(docs, index, True, a.calibrated, neutral))}
    if a.spans:
        made["tagged"] = written(tagger.merge(docs, made["main"], files.read_spans(spark, a.spans), index, calibrated=a.calibrated))
    rows = {}
    for name, citations in made.items():
        folder = f"{a.out}/json_{name}"
        files.write_contract_files(contract(docs, citations), folder)
        if _checked(docs, folder):
            print(f"{name}: the contract isn't kept; no submission written")
            return 1
        rows[name] = submission(docs, citations)
        _csv(rows[name], f"{a.out}/submission{'' if name == 'main' else '_' + name}.csv")
    for r in evaluate.counts_by_variant(rows).orderBy("variant").collect():
        print(" ".join(f"{k}={v}" for k, v in r.asDict().items()))
    if a.gold:
        for name, citations in made.items():
            _print_scores(name, files.read_gold(spark, a.gold), citations, rows[name], a.metric)
    return 0


def _print_scores(name: str, gold: DataFrame, citations: DataFrame, rows: DataFrame, metric: str | None) -> None:
    p = citations.withColumn("p", F.col("start"))
    for r in evaluate.verdict_scores(gold, p).orderBy("level", "class").collect():
        print(f"{name} level {r.level} {r['class']}: F1 {r.f1:.4f} (macro {r.macro_f1:.4f}, tau {r.tau:.4f})")
    if metric:
        print(f"{name}: {evaluate.external_score(evaluate.solution(gold), rows, metric)['score_final']:.4f}")


def index(a) -> int:
    spark = _session()
    files.write_index(build(files.read_registry(spark, a.registry)), a.out)
    return 0


def check(a) -> int:
    return int(bool(_checked(files.read_texts(_session(), a.texts), a.json)))


def score(a) -> int:
    spark = _session()
    gold = files.read_gold(spark, a.gold)
    citations = files.read_contract(spark, a.json)
    docs = gold.select("document_id").distinct()
    _print_scores("score", gold, citations, submission(docs, citations), a.metric)
    return 0


def main(argv=None) -> int:
    top = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = top.add_subparsers(required=True)
    for run, places, options in (
        (submit, ("registry", "texts", "out"), ("--templates", "--spans", "--gold", "--metric")), (index, ("registry", "out"), ()),
        (check, ("json", "texts"), ()), (score, ("json", "gold"), ("--metric",)),
    ):
        p = sub.add_parser(run.__name__)
        for x in (*places, *options):
            p.add_argument(x)
        if run is submit:
            p.add_argument("--calibrated", action="store_true")
        p.set_defaults(run=run)
    a = top.parse_args(argv)
    return a.run(a)


if __name__ == "__main__":
    sys.exit(main())
