"""Readers and writers, and the demand tables that the test data yields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.calendar import week_ending
from ..operators.series import densify_weekly
from ..schema import DATE, ID, Y


def read_demand(spark: SparkSession, path: str, kind: str | None = None, schema: StructType | str | None = None, date_col: str | None = None) -> DataFrame:
    """CSV (header; types inferred without a schema) or Parquet, by ``kind`` or the path's ending; date_col becomes a date."""
    kind = kind or ("csv" if path.rstrip("/").endswith((".csv", ".csv.gz")) else "parquet")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if kind == "csv":
        df = reader.option("header", True).option("inferSchema", schema is None).csv(path)
    elif kind == "parquet":
        df = reader.parquet(path)
    else:
        raise ValueError(f"unknown kind {kind}")
    return df.withColumn(date_col, F.col(date_col).cast("date")) if date_col else df


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header; ``single`` makes one file, for results that one task can hold."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def weekly_demand(rows: DataFrame, key: Column, ts: Column, quantity: Column) -> DataFrame:
    """Demand by key and week-ending Sunday with gaps filled: a table of internal names. Sums before it shuffles."""
    weekly = rows.groupBy(key.alias(ID), week_ending(ts).alias(DATE)).agg(F.sum(quantity).cast("double").alias(Y))
    return densify_weekly(weekly.filter(F.col(ID).isNotNull()))


def supplier_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weekly_demand(read_table(spark, sf_dir, "lineitem"), F.col("l_suppkey"), F.col("l_shipdate"), F.col("l_quantity"))


def part_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weekly_demand(read_table(spark, sf_dir, "lineitem"), F.col("l_partkey"), F.col("l_shipdate"), F.col("l_quantity"))


def named(df: DataFrame) -> DataFrame:
    """Internal names as caller's names: item_id, date, demand."""
    return df.withColumnsRenamed({ID: "item_id", DATE: "date", Y: "demand"})


def part_weeks_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, date, demand, p_brand, p_type."""
    part = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), "p_brand", "p_type")
    return named(part_weeks(spark, sf_dir)).join(part, "item_id")


def event_days(spark: SparkSession, sf_dir: str, item: str = "user_id") -> DataFrame:
    """item_field, date_field, quantity_field: daily sums of events."""
    events = read_table(spark, sf_dir, "events")
    return events.groupBy(F.col(item).alias("item_field"), F.col("ts").cast("date").alias("date_field")).agg(F.round(F.sum("value"), 6).alias("quantity_field"))
