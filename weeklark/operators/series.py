"""From demand rows to series: densify, index, split, and the one-row-per-series table.

The plan deals rows by series once and gathers each series into one row; the
train/test split, the week profile and all models are expressions over that
row. A series is one row of two numbers a week, so its size is bounded by
the calendar, not by the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import iso_week
from ..functions.columns import at, let, settled
from ..schema import DATE, ID, Y

#: Growth of the weight of a week from one year to the next (a decay of 0.8 per year back).
DECAY = 0.8


def densify_weekly(df: DataFrame, last: Column | None = None) -> DataFrame:
    """Fill the missing weeks of every series with zeros, from its first week to ``last`` (default: the table's last).

    Every row fills the weeks up to the next row of its series, so nothing
    is joined. Needs internal names, one row per series and week. A null
    date goes; a null demand counts as zero.
    """
    known = df.filter(F.col(DATE).isNotNull())
    if last is None:
        end = known.agg(F.max(DATE).alias("__end"))
        known = known.crossJoin(F.broadcast(end))  # one row
        last = F.col("__end")
    after = F.lead(DATE).over(Window.partitionBy(ID).orderBy(DATE))
    gap = F.greatest(F.floor(F.datediff(F.coalesce(after, F.date_add(last, 7)), F.col(DATE)) / 7), F.lit(1)).cast("int")
    filled = known.withColumn("__gap", gap).withColumn("__k", F.explode(F.sequence(F.lit(0), F.col("__gap") - 1)))
    return filled.select(
        *[F.col(c) for c in df.columns if c not in (DATE, Y)],
        F.date_add(F.col(DATE), F.col("__k") * 7).alias(DATE),
        F.when(F.col("__k") == 0, F.coalesce(Y, F.lit(0.0))).otherwise(0.0).alias(Y),
    )


def indexed(df: DataFrame) -> DataFrame:
    """Add i (0-based place in the series by date), n (rows of the series), week and the running number of the year."""
    by_date = Window.partitionBy(ID).orderBy(DATE)
    year = F.year(DATE)
    rows = df.withColumns({
        "i": F.row_number().over(by_date) - 1,
        "n": F.count(F.lit(1)).over(Window.partitionBy(ID)).cast("int"),
        "week": iso_week(F.col(DATE)),
        "__new": F.when(year == F.lag(year).over(by_date), 0).otherwise(1),
    })
    return rows.withColumn("year_no", F.sum("__new").over(by_date)).drop("__new")


def series_table(df: DataFrame, holdout: int = 0, min_rows: int = 0, decay: float = DECAY, profiles: bool = True) -> DataFrame:
    """One row per series of at least ``min_rows`` rows. Rows of a null date go; equal dates sort by demand.

    Columns: id, n, m (training rows), y (training demand), train_dates,
    weeks, last (last training date), test, test_dates, and by ISO week 1..53 (null for
    unseen weeks) the mean, median and weighted mean of the training part;
    gmean, gmedian, overall (mean of week means). Without ``profiles``, none
    by ISO week, nor weeks, gmedian and overall.
    """
    rows = df.filter(F.col(DATE).isNotNull()).groupBy(ID).agg(F.sort_array(F.collect_list(F.struct(F.col(DATE).alias("d"), F.col(Y).alias("y")))).alias("rows"))
    n = F.size("rows")
    m = F.greatest(n - holdout, F.lit(0))
    sized = rows.filter(n >= min_rows).select(ID, n.alias("n"), m.alias("m"), F.slice("rows", F.lit(1), m).alias("head"), F.slice("rows", m + 1, F.greatest(n - m, F.lit(0))).alias("tail"))
    if not profiles:
        plain = settled(settled(sized).select(
            ID, "n", "m", F.transform("head", lambda r: r["y"]).alias("y"), F.transform("head", lambda r: r["d"]).alias("train_dates"), F.get("head", F.col("m") - 1)["d"].alias("last"),
            F.transform("tail", lambda r: r["y"]).alias("test"), F.transform("tail", lambda r: r["d"]).alias("test_dates")))
        return settled(plain.withColumn("gmean", mean_of(F.col("y"))))
    years = F.array_distinct(F.transform("head", lambda r: F.year(r["d"])))
    # By week, then demand: a week's rows stand together, in order of demand.
    weighted = let(years, lambda ys: F.transform("head", lambda r: F.struct(
        iso_week(r["d"]).alias("w"), r["y"].alias("y"), F.pow(F.lit(1.0 / decay), F.array_position(ys, F.year(r["d"]))).alias("k"))))
    split = settled(settled(settled(sized).withColumn("train", weighted)).select("*", F.sort_array("train").alias("by_week")))
    split = settled(split.withColumn("week_of", F.transform("by_week", lambda r: r["w"])))
    split = settled(split.withColumn("week_back", F.reverse("week_of")))

    def of_week(rows_: Column) -> Column:
        n_ = F.size(rows_)
        sums = F.aggregate(
            rows_, F.struct(F.lit(0.0).alias("y"), F.lit(0.0).alias("v"), F.lit(0.0).alias("k")),
            lambda a, r: F.struct((a["y"] + r["y"]).alias("y"), (a["v"] + r["y"] * r["k"]).alias("v"), (a["k"] + r["k"]).alias("k")))
        return let(sums, lambda t: F.struct(
            (t["y"] / n_).alias("mean"), ((at(rows_, F.floor((n_ - 1) / 2))["y"] + at(rows_, F.floor(n_ / 2))["y"]) / 2).alias("median"),
            (t["v"] / F.nullif(t["k"], F.lit(0.0))).alias("weighted")))

    def rows_of(w: Column) -> Column:
        first = F.array_position("week_of", w)
        return let(first, lambda p: F.when(p > 0, let(
            F.slice("by_week", p.cast("int"), (F.col("m") + 2 - F.array_position("week_back", w) - p).cast("int")), of_week)))

    by_no = F.transform(F.sequence(F.lit(1), F.lit(53)), rows_of)
    profiled = settled(split.withColumn("by_no", by_no))
    field = lambda xs, f: F.transform(xs, lambda r: r[f])
    seen = F.filter("by_no", lambda p: p.isNotNull())
    arrays = settled(profiled.select(
        ID, "n", "m", field("train", "y").alias("y"), field("head", "d").alias("train_dates"), field("train", "w").alias("weeks"), F.get("head", F.col("m") - 1)["d"].alias("last"),
        field("tail", "y").alias("test"), field("tail", "d").alias("test_dates"),
        field("by_no", "mean").alias("week_mean"), field("by_no", "median").alias("week_median"), field("by_no", "weighted").alias("week_weighted"),
        let(seen, lambda ps: F.aggregate(ps, F.lit(0.0), lambda a, p: a + p["mean"]) / F.nullif(F.size(ps), F.lit(0))).alias("overall"),
    ))
    return settled(arrays.withColumns({"gmean": mean_of(F.col("y")), "gmedian": median_of(F.col("y"))}))


def mean_of(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(xs), F.lit(0))


def median_of(xs: Column) -> Column:
    def middle(s: Column) -> Column:
        n = F.size(s)
        return (at(s, F.floor((n - 1) / 2)) + at(s, F.floor(n / 2))) / 2

    return F.when(F.size(xs) > 0, let(F.array_sort(xs), middle))
