"""Command line: `python -m lociflow.cli COMMAND ...`."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lociflow")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("corpus", "genotype"):
        commands.add_parser(name).add_argument("config")
    w = commands.add_parser("windows")
    w.add_argument("vcf")
    w.add_argument("fasta")
    w.add_argument("output")
    w.add_argument("--samples", help="CSV with a column sample_id")
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName(f"lociflow-{a.command}").getOrCreate()
    try:
        if a.command == "corpus":
            from lociflow.plans import corpus
            from lociflow.plans.config import corpus_plan

            corpus.run(spark, corpus_plan(a.config)).show(truncate=False)
        elif a.command == "genotype":
            from lociflow.plans import genotype
            from lociflow.plans.config import genotype_plan

            genotype.evaluate(spark, genotype_plan(a.config)).show(truncate=False)
        else:
            from lociflow.plans import genotype
            from lociflow.sources import corpus, tables

            found, absent = genotype.finetune_windows(spark, a.vcf, a.fasta, tables.sample_list(spark, a.samples) if a.samples else None)
            corpus.write_json_lines(found, a.output)
            if absent:
                print(f"not in the VCF: {absent}")
    except (RuntimeError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
