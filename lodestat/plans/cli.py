"""python -m lodestat.plans.cli validate|canonical|hash SPEC, or run SPEC FOLDER [--k N]."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from .spec import AnalysisSpec, SpecError


def main(arguments: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="lodestat")
    parser.add_argument("what", choices=("validate", "canonical", "hash", "run"))
    parser.add_argument("spec", type=Path)
    parser.add_argument("folder", nargs="?")
    parser.add_argument("--k", type=int, default=5)
    given = parser.parse_args(arguments)
    try:
        spec = AnalysisSpec.parse(given.spec.read_text())
    except SpecError as error:
        print(error, file=sys.stderr)
        return 1
    if given.what != "run":
        print({"validate": "valid", "canonical": spec.canonical(), "hash": spec.digest()}[given.what])
        return 0
    from pyspark.sql import SparkSession

    from lodestat.sources.observations import observations

    from .engine import SourcePolicy, run_spec

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    policies = [SourcePolicy(s, (spec.purpose,), k_min=given.k) for s in spec.sources]
    for row in run_spec(observations(spark, given.folder), spec, policies).toJSON().toLocalIterator():
        print(row)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
