"""Routed backtest from CSV to CSV.

    spark-submit weeklark/cli.py demand.csv -o folds --kind statistical
    python -m weeklark.cli demand.csv -o folds --group-col brand,type
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from weeklark.plans.routed import generate_fold_details
from weeklark.sources.tables import read_demand, write_csv


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("input_csv")
    p.add_argument("-o", "--output", default="fold_details")
    p.add_argument("--kind", choices=("full", "statistical", "gbt"), default="full")
    p.add_argument("--date-col", default="date")
    p.add_argument("--id-col", default="item_id")
    p.add_argument("--value-col", default="demand")
    p.add_argument("--group-col", default=None, help="one column, or several with commas between")
    p.add_argument("--eval-window", type=int, default=52)
    p.add_argument("--min-train", type=int, default=52)
    p.add_argument("--new-item-share", type=float, default=0.10)
    p.add_argument("--workers", type=int, default=None, help="accepted and not used: the cluster decides")
    p.add_argument("--single-file", action="store_true")
    return p


def main(args: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("weeklark").getOrCreate()
    groups = [c.strip() for c in a.group_col.split(",") if c.strip()] if a.group_col else []
    details = generate_fold_details(
        read_demand(spark, a.input_csv, "csv"), a.date_col, a.id_col, a.value_col, groups[0] if len(groups) == 1 else groups or None,
        a.eval_window, a.min_train, a.new_item_share, a.workers, a.kind)
    write_csv(details, a.output, a.single_file)


if __name__ == "__main__":
    main()
