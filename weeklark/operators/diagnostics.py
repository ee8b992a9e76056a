"""Pattern labels and outlier dates per item: its own definitions of ADI and CV2, unlike the demand classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import nan

# Class limits (strict here) and the fence in quartile ranges.
ADI_LIMIT, CV2_LIMIT, FENCE = 1.32, 0.49, 1.5


def get_diagnostics(df: DataFrame, item: str = "item_field", quantity: str = "quantity_field", date: str = "date_field") -> DataFrame:
    """One row per item: Forecast Series, ADI, CV2, Demand Pattern, Flagged Outliers. One shuffle.

    ADI is rows per nonzero row (negative and null quantities count as
    nonzero); CV2 takes the sample deviation of positive quantities and is
    NaN for a single one, which makes the item Lumpy. Outliers lie beyond
    1.5 quartile ranges; their dates are listed in order, an empty text if
    there are none. Null items go.
    """
    q = F.col("q")
    rows = df.filter(F.col(item).isNotNull()).select(
        F.col(item).alias("item"), F.col(quantity).cast("double").alias("q"), F.col(date).cast("date").alias("d"))
    positive = F.when(q > 0, q)
    per = rows.groupBy("item").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(q.isNull() | (q != 0), 1)).alias("k"),
        F.avg(positive).alias("mean"), F.stddev_samp(positive).alias("sd"),
        F.percentile(q, F.array(F.lit(0.25), F.lit(0.75))).alias("quartiles"), F.collect_list(F.struct("d", "q")).alias("points"),
    )
    low, high = F.get("quartiles", F.lit(0)), F.get("quartiles", F.lit(1))
    none = F.col("k") == 0
    adi = F.when(none, nan()).otherwise(F.col("n") / F.nullif(F.col("k"), F.lit(0)))
    cv = F.col("sd") / F.nullif(F.col("mean"), F.lit(0.0))
    cv2 = F.when(none, nan()).otherwise(F.coalesce(cv * cv, nan()))
    known = per.select("item", adi.alias("adi"), cv2.alias("cv2"), none.alias("none"), low.alias("lo"), high.alias("hi"), "points")
    a, c = F.col("adi") < ADI_LIMIT, (F.col("cv2") < CV2_LIMIT) & ~F.isnan("cv2")
    big = (F.col("cv2") >= CV2_LIMIT) & ~F.isnan("cv2")
    pattern = F.when(F.col("none"), "No Demand").when(a & c, "Smooth").when(~a & c, "Intermittent").when(a & big, "Erratic").otherwise("Lumpy")
    reach = FENCE * (F.col("hi") - F.col("lo"))
    out = F.filter("points", lambda p: (p["q"] < F.col("lo") - reach) | (p["q"] > F.col("hi") + reach))
    dates = F.array_join(F.transform(F.array_sort(F.transform(out, lambda p: p["d"])), lambda d: F.date_format(d, "yyyy-MM-dd")), ", ")
    return known.select(
        F.col("item").alias("Forecast Series"), F.col("adi").alias("ADI"), F.col("cv2").alias("CV2"), pattern.alias("Demand Pattern"), dates.alias("Flagged Outliers"))
