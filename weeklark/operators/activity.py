"""Inactive items: no demand in the trailing weeks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DATE, ID, Y, normalise


def activity(df: DataFrame, inactive_weeks: int = 26) -> DataFrame:
    """Per series: trailing sum, last nonzero date, weeks since, count and sum. One aggregation, one shuffle.

    The cut is strict: only dates after the table's last date minus the
    weeks count as trailing. Needs internal names.
    """
    last = F.broadcast(df.agg(F.max(DATE).alias("__last")))
    trailing = F.col(DATE) > F.date_sub(F.col("__last"), 7 * inactive_weeks)
    per = df.crossJoin(last).groupBy(ID).agg(  # one row
        F.sum(F.when(trailing, F.col(Y)).otherwise(0.0)).alias("trailing"),
        F.max(F.when(F.col(Y) > 0, F.col(DATE))).alias("last_nonzero_date"),
        F.count(DATE).alias("total_history_weeks"), F.sum(Y).alias("lifetime_total_qty"), F.max("__last").alias("__last"),
    )
    return per.withColumn("weeks_since_demand", F.floor(F.datediff("__last", "last_nonzero_date") / 7).cast("int")).drop("__last")


def flag_inactive_items(df: DataFrame, date_col: str, id_col: str, value_col: str, inactive_weeks: int = 26) -> tuple[DataFrame, DataFrame]:
    """(rows of active series, one row per inactive series).

    A series is active if its trailing sum is above zero and inactive if it
    is zero; one with a negative trailing sum is neither. Rows of a null id
    go. With inactive_weeks <= 0 every series is active.
    """
    rows = df.filter(F.col(id_col).isNotNull())
    per = activity(normalise(df, date_col, id_col, value_col), inactive_weeks)
    inactive = per.filter(F.col("trailing") == 0 if inactive_weeks > 0 else F.lit(False)).select(
        F.col(ID).alias(id_col), F.lit("inactive").alias("status"), "last_nonzero_date", "weeks_since_demand", "total_history_weeks", "lifetime_total_qty")
    if inactive_weeks <= 0:
        return rows, inactive
    return rows.join(per.filter(F.col("trailing") > 0).select(F.col(ID).alias(id_col)), id_col, "left_semi"), inactive
