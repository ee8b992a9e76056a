"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weeklark.operators.activity import activity
from weeklark.operators.classify import classify_demand
from weeklark.operators.diagnostics import get_diagnostics
from weeklark.operators.evaluate import evaluate_benchmarks, select_best_fit
from weeklark.plans.pipeline import best_fit_pipeline
from weeklark.plans.routed import generate_fold_details
from weeklark.sources.tables import event_days, named, part_weeks, part_weeks_grouped, supplier_weeks

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
NAMES = ("date", "item_id", "demand")


def tournament(source):
    return lambda spark: select_best_fit(evaluate_benchmarks(named(source(spark, SF)), *NAMES)[0], "item_id")


def part_checks(spark):
    """Activity, demand class and diagnostics of every part."""
    df = part_weeks(spark, SF)
    labels = get_diagnostics(named(df).withColumnsRenamed({"item_id": "item_field", "demand": "quantity_field", "date": "date_field"}))
    return activity(df).join(classify_demand(df, 52), "__id").join(labels, F.col("__id") == F.col("Forecast Series"))


QUERIES = {
    "supplier_tournament": tournament(supplier_weeks),
    "part_tournament": tournament(part_weeks),
    "supplier_final_forecast": lambda spark: best_fit_pipeline(named(supplier_weeks(spark, SF)), *NAMES)[2],
    "part_routed_fold_details": lambda spark: generate_fold_details(part_weeks_grouped(spark, SF), group_col="p_brand", min_train_weeks=250),
    "part_activity_classes_diagnostics": part_checks,
    "event_diagnostics": lambda spark: get_diagnostics(event_days(spark, SF)),
}


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(2 * int(CPUS))).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    only = os.environ.get("BENCH_ONLY")
    for name, query in QUERIES.items():
        if only and name not in only.split(","):
            continue
        began = time.time()
        query(spark).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
