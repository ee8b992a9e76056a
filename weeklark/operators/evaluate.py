"""Backtest on one holdout, and the tournament that picks a model per series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import four_digits, is_finite, nan
from ..functions.registry import TOURNAMENT, known, order_of, tournament_names
from ..schema import ID, normalise
from .forecast import FORECASTS, mase_of, naive_error, wape_of, with_forecasts
from .series import series_table

#: Metrics are rounded to so many decimals before they are compared, so that equal models tie on any machine.
TIE_DECIMALS = 10


def backtest(df: DataFrame, eval_window: int = 52, min_train_weeks: int = 52, names: Sequence[str] | None = None, tier: str = "full") -> DataFrame:
    """The series table with forecasts of the holdout. Needs internal names."""
    series = series_table(df, eval_window, eval_window + min_train_weeks)
    return with_forecasts(series, list(names) if names is not None else tournament_names(tier), eval_window)


def eval_frame(tested: DataFrame, id_col: str) -> DataFrame:
    """One row per series and model with both metrics and the totals; no shuffle."""
    rows = tested.withColumn("__naive", naive_error(F.col("y"))).select(ID, "test", "__naive", F.explode(FORECASTS).alias("x"))
    f = F.col("x.f")
    wape = wape_of(F.col("test"), f)
    sums = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    scored = rows.select(
        F.col(ID).alias(id_col), F.col("x.model").alias("model"), wape.alias("wape"), mase_of(F.col("test"), f, F.col("__naive")).alias("mase"),
        sums(F.col("test")).alias("total_actual"), sums(f).alias("total_forecast"), F.lit(1).alias("n_folds"), F.lit(0.0).alias("wape_std"))
    return scored.withColumn("fold_wapes", F.when(is_finite(F.col("wape")), four_digits(F.col("wape"))).otherwise("inf"))


def fold_frame(tested: DataFrame, id_col: str, extra: Sequence[Column] = ()) -> DataFrame:
    """One row per series, model and week of the holdout: actual and forecast, matched by place."""
    rows = tested.select("*", F.explode(FORECASTS).alias("x"))
    weeks = rows.select(ID, *extra, F.col("x.model").alias("model"), F.explode(F.arrays_zip(
        F.col("test_dates").alias("date"), F.col("test").alias("actual"), F.col("x.f").alias("forecast"))).alias("w"))
    middle = [c for c in weeks.columns if c not in (ID, "model", "w")]
    return weeks.select(F.col(ID).alias(id_col), "model", *middle, F.lit(1).alias("fold"), F.col("w.date").alias("date"), F.col("w.actual").alias("actual"), F.col("w.forecast").alias("forecast"))


def evaluate_benchmarks(
    df: DataFrame, date_col: str, id_col: str, value_col: str, eval_window: int = 52, min_train_weeks: int = 52, n_workers: int | None = None,
    tier: str = "full", names: Sequence[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(eval_df, fold_details_df). n_workers is accepted and not used: the cluster decides."""
    tested = backtest(normalise(df, date_col, id_col, value_col), eval_window, min_train_weeks, names, tier)
    return eval_frame(tested, id_col), fold_frame(tested, id_col)


def _order_column(model: Column) -> Column:
    names = known(TOURNAMENT) + [n for n in tournament_names("full") if n not in TOURNAMENT]
    out = F.lit(len(names) + 1)
    for name in reversed(names):
        out = F.when(model == name, F.lit(order_of(name))).otherwise(out)
    return out


def select_best_fit(
    eval_df: DataFrame, id_col: str, primary_metric: str = "wape", secondary_metric: str = "mase", primary_weight: float = 0.7,
    secondary_weight: float = 0.3, fallback_model: str = "seasonal_naive", tie_decimals: int | None = TIE_DECIMALS,
) -> DataFrame:
    """One row per series: the model of the least weighted sum of both metrics, each scaled to 0..1 within the series.

    Only rows with both metrics finite compete. Equal sums go to the smaller
    primary metric, then to the earlier model (``tiebreak``). A series
    without such rows gets the fallback model, or its first, with a NaN
    score (``fallback``). All windows deal by series, once.
    """
    r = (lambda c: F.round(c, tie_decimals)) if tie_decimals is not None else (lambda c: c)
    own = Window.partitionBy(id_col)
    good = is_finite(F.col(primary_metric)) & is_finite(F.col(secondary_metric))
    rows = eval_df.withColumns({"__ok": good, "__ord": _order_column(F.col("model"))})
    p, s = (F.when(F.col("__ok"), r(F.col(m))) for m in (primary_metric, secondary_metric))
    rows = rows.withColumns({"__p": p, "__s": s})
    scaled = {}
    for m in ("__p", "__s"):
        low, high = F.min(m).over(own), F.max(m).over(own)
        scaled[m] = F.when(high > low, (F.col(m) - low) / F.nullif(high - low, F.lit(0.0))).when(F.col(m).isNotNull(), 0.0)
    rows = rows.withColumn("__score", r(primary_weight * scaled["__p"] + secondary_weight * scaled["__s"]))
    best = F.min("__score").over(own)
    rows = rows.withColumns({"__best": best, "__ties": F.sum(F.when(F.col("__score") == best, 1).otherwise(0)).over(own)})
    rank = F.row_number().over(own.orderBy(
        F.col("__score").asc_nulls_last(), F.col("__p").asc_nulls_last(), F.when(F.col("__best").isNull() & (F.col("model") != fallback_model), 1).otherwise(0), "__ord", "model"))
    first = rows.withColumn("__rank", rank).filter(F.col("__rank") == 1)
    method = F.when(F.col("__best").isNull(), "fallback").when(F.col("__ties") > 1, "tiebreak").otherwise("tournament")
    return first.select(
        id_col, F.col("model").alias("best_model"), F.coalesce("__score", nan()).alias("composite_score"), primary_metric, secondary_metric,
        "total_actual", "total_forecast", "n_folds", "wape_std", method.alias("selection_method"))


def summarize_results(best_fit_df: DataFrame, eval_df: DataFrame, id_col: str, inactive_df: DataFrame | None = None) -> DataFrame:
    """One row per winning model, most wins first: wins, share, medians of finite metrics, demand-weighted WAPE, median spread.

    A share on a tie is rounded up, as in SQL (pandas would take the even digit).
    ``inactive_df`` is accepted for the sake of callers and not used.
    """
    wins = best_fit_df.groupBy(F.col("best_model").alias("model")).agg(F.count(F.lit(1)).alias("wins"), F.median("wape_std").alias("median_wape_std"))
    n = F.broadcast(best_fit_df.agg(F.count(F.lit(1)).alias("__n")))
    finite = eval_df.filter(is_finite(F.col("wape")) & is_finite(F.col("mase")))
    per = finite.groupBy("model").agg(
        F.median("wape").alias("median_wape"), F.median("mase").alias("median_mase"),
        F.when(F.sum("total_actual") > 0, F.sum(F.col("wape") * F.col("total_actual")) / F.nullif(F.sum("total_actual"), F.lit(0.0))).otherwise(nan()).alias("demand_weighted_wape"))
    joined = wins.crossJoin(n).join(per, "model", "left")  # n is one row
    return joined.select(
        "model", "wins", F.round(F.col("wins") * 100.0 / F.col("__n"), 1).alias("win_pct"), "median_wape", "median_mase", "demand_weighted_wape", "median_wape_std",
    ).orderBy(F.col("wins").desc(), "model")
