"""spark-submit jobs/bootstrap.py DEMOGRAPHIC QUESTIONNAIRE OUTPUT: prepare, train, report, audit."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from visitgauge.plans.audit import audit
from visitgauge.plans.fairness import bootstrap


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("demographic")
    parser.add_argument("questionnaire")
    parser.add_argument("output")
    parser.add_argument("--test-size", type=float, default=0.3)
    parser.add_argument("--seed", type=int, default=42)
    parser.add_argument("--no-oversampling", action="store_true")
    parser.add_argument("--boosted", action="store_true")
    given = parser.parse_args()
    spark = SparkSession.builder.appName("screening-bootstrap").getOrCreate()
    paths = bootstrap(
        spark, given.demographic, given.questionnaire, given.output, given.test_size, given.seed,
        boosted=given.boosted, oversampled=not given.no_oversampling,
    )
    audit(spark, given.demographic, given.questionnaire, paths, f"{given.output}/audit")
    for name, path in paths.items():
        print(f"{name}: {path}")


if __name__ == "__main__":
    main()
