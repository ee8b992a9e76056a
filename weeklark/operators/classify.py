"""Demand classes from the mean interval between demands (ADI) and the squared variation of sizes (CV2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let
from ..functions.registry import get_models_for_category, order_of
from ..schema import CATEGORIES, DATE, ID, Y
from .series import indexed

# Class limits.
ADI_LIMIT, CV2_LIMIT = 1.32, 0.49


def category_of(adi: Column, cv2: Column) -> Column:
    return F.when(adi <= ADI_LIMIT, F.when(cv2 > CV2_LIMIT, "erratic").otherwise("smooth")).otherwise(
        F.when(cv2 > CV2_LIMIT, "lumpy").otherwise("intermittent"))


def classify_demand(df: DataFrame, holdout: int = 0, min_rows: int = 0) -> DataFrame:
    """(id, adi, cv2, category) of the part of each series before the holdout. Needs internal names.

    The mean gap of nonzero places telescopes to (last - first) / (k - 1);
    with one nonzero it is the length, with none the class is lumpy.
    """
    rows = indexed(df).filter((F.col("n") >= min_rows) & (F.col("i") < F.col("n") - holdout))
    nz = lambda c: F.when(F.col(Y) > 0, c)
    per = rows.groupBy(ID).agg(
        F.count(F.lit(1)).alias("m"), F.count(nz(F.lit(1))).alias("k"), F.min(nz(F.col("i"))).alias("lo"), F.max(nz(F.col("i"))).alias("hi"),
        F.avg(nz(F.col(Y))).alias("mean"), F.stddev_pop(nz(F.col(Y))).alias("sd"),
    )
    adi = F.when(F.col("k") > 1, (F.col("hi") - F.col("lo")) / (F.col("k") - 1)).otherwise(F.col("m").cast("double"))
    ratio = F.col("sd") / F.nullif(F.col("mean"), F.lit(0.0))
    return per.select(
        ID, adi.alias("adi"), (ratio * ratio).alias("cv2"),
        F.when(F.col("k") == 0, "lumpy").otherwise(category_of(adi, F.coalesce(ratio * ratio, F.lit(0.0)))).alias("category"))


def category_column(y: Column) -> Column:
    """The same class from an array of demand."""
    places = F.filter(F.transform(y, lambda v, i: F.when(v > 0, i)), lambda i: i.isNotNull())
    sizes = F.filter(y, lambda v: v > 0)

    def judge(p: Column) -> Column:
        k = F.size(p)
        adi = F.when(k > 1, (F.element_at(p, -1) - F.element_at(p, 1)) / F.greatest(k - 1, F.lit(1))).otherwise(F.size(y).cast("double"))
        sums = F.aggregate(sizes, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")), lambda a, v: F.struct((a["s"] + v).alias("s"), (a["q"] + v * v).alias("q")))
        cv2 = let(sums, lambda t: F.greatest(t["q"] * k / F.nullif(t["s"] * t["s"], F.lit(0.0)) - 1, F.lit(0.0)))
        return F.when(k == 0, "lumpy").otherwise(let(F.struct(adi.alias("a"), F.coalesce(cv2, F.lit(0.0)).alias("c")), lambda x: category_of(x["a"], x["c"])))

    return let(places, judge)


def routing_table(spark, kind: str = "full") -> DataFrame:
    """(category, model, model_ord): a few rows."""
    rows = [(c, m, order_of(m)) for c in CATEGORIES for m in get_models_for_category(c, kind)]
    return spark.createDataFrame(rows, "category string, model string, model_ord int")


def route_models(classified: DataFrame, kind: str = "full") -> DataFrame:
    """One row per series and model of its class."""
    return classified.join(F.broadcast(routing_table(classified.sparkSession, kind)), "category")


__all__ = ["ADI_LIMIT", "CV2_LIMIT", "DATE", "category_column", "category_of", "classify_demand", "route_models", "routing_table"]
