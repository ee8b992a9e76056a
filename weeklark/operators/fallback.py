"""Series with too little history: forecasts of their group's sum, dealt out by recent shares, or a flat mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let
from ..schema import DATE, GRP, ID, Y
from .series import mean_of

RECENT_WEEKS = 26
NEW_ITEM_SHARE = 0.10


def aggregate_series(rows: DataFrame) -> DataFrame:
    """Sum by group and date of all series, as a demand table whose series are the groups. Null groups go."""
    return rows.filter(F.col(GRP).isNotNull()).groupBy(F.col(GRP).alias(ID), DATE).agg(F.sum(Y).alias(Y))


def group_calendar(group_rows: DataFrame, eval_window: int) -> DataFrame:
    """(grp, n_dates, cut, last_train): the dates before ``cut`` are the training part (null: all of them)."""
    per = group_rows.groupBy(F.col(ID).alias(GRP)).agg(F.array_sort(F.collect_set(DATE)).alias("dates"))
    n = F.size("dates")
    long = n > eval_window
    return per.select(
        GRP, n.alias("n_dates"), F.when(long, F.get("dates", n - eval_window)).alias("cut"),
        F.when(long, F.get("dates", n - eval_window - 1)).otherwise(F.get("dates", n - 1)).alias("last_train"))


def item_shares(short_rows: DataFrame, calendar: DataFrame, new_item_share: float = NEW_ITEM_SHARE, recent_weeks: int = RECENT_WEEKS) -> DataFrame:
    """(grp, id, recent, share) of the short series of each group.

    Demand of the last weeks of the group's training part counts (both ends
    included). Where a group has series with and without such demand, those
    without share ``new_item_share`` equally and the others the rest by
    demand. A negative sum gets an equal share of the whole. Sums per group
    are aggregated and joined back, so a large group is not one task.
    """
    dated = short_rows.filter(F.col(GRP).isNotNull()).join(calendar, GRP)
    in_time = (F.col("cut").isNull() | (F.col(DATE) < F.col("cut"))) & (F.col(DATE) >= F.date_sub("last_train", 7 * recent_weeks))
    items = dated.groupBy(GRP, ID).agg(F.sum(F.when(in_time, F.col(Y)).otherwise(0.0)).alias("recent"))
    d = F.col("recent")
    totals = items.groupBy(GRP).agg(
        F.sum(F.when(d > 0, d).otherwise(0.0)).alias("__sum"), F.count(F.when(d == 0, 1)).alias("__zeros"), F.count(F.lit(1)).alias("__all"))
    both = (F.col("__zeros") > 0) & (F.col("__sum") > 0)
    sold = d / F.nullif(F.col("__sum"), F.lit(0.0)) * F.when(both, 1 - new_item_share).otherwise(1.0)
    unsold = F.when(both, F.lit(new_item_share)).otherwise(1.0) / F.nullif(F.col("__zeros"), F.lit(0))
    share = F.when(d > 0, sold).when(d == 0, unsold).otherwise(1.0 / F.col("__all"))
    return items.join(totals, GRP).select(GRP, ID, "recent", share.alias("share"))


def flat_forecast(horizon: int) -> Column:
    """Mean of the training part, or of the test part where that is all there is; never below zero."""
    value = F.greatest(F.coalesce(F.col("gmean"), mean_of(F.col("test"))), F.lit(0.0))
    return let(value, lambda v: F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda s: v))
