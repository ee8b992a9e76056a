"""The tournament pipeline: filter, evaluate, select, and forecast with the winner only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import horizon_dates
from ..functions.registry import tournament_names
from ..operators.activity import flag_inactive_items
from ..operators.evaluate import evaluate_benchmarks, select_best_fit
from ..operators.forecast import FORECASTS, with_forecasts
from ..operators.series import series_table
from ..schema import ID, normalise


def forecast_winners(df: DataFrame, best_fit_df: DataFrame, date_col: str, id_col: str, value_col: str, horizon: int = 52, tier: str = "full") -> DataFrame:
    """(id, model, date, forecast, step) of every series with a winner, over its whole history; no other model is computed."""
    series = series_table(normalise(df, date_col, id_col, value_col))
    won = series.join(best_fit_df.select(F.col(id_col).alias(ID), F.col("best_model").alias("__best")), ID)
    run = with_forecasts(won, tournament_names(tier), horizon, wanted="__best")
    steps = run.select(ID, F.explode(FORECASTS).alias("x"), horizon_dates(F.col("last"), horizon).alias("dates")).select(
        ID, "x.model", F.posexplode(F.arrays_zip(F.col("dates").alias("date"), F.col("x.f").alias("forecast"))).alias("at", "w"))
    return steps.select(F.col(ID).alias(id_col), "model", F.col("w.date").alias("date"), F.col("w.forecast").alias("forecast"), (F.col("at") + 1).alias("step"))


def best_fit_pipeline(
    df: DataFrame, date_col: str, id_col: str, value_col: str, horizon: int = 52, eval_window: int = 52, inactive_weeks: int = 26,
    primary_metric: str = "wape", secondary_metric: str = "mase", primary_weight: float = 0.7, secondary_weight: float = 0.3,
    n_workers: int | None = None, tier: str = "full",
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(eval_df, best_fit_df, forecast_df, inactive_df, fold_details_df), all lazy and fully typed, also when empty.

    n_workers is accepted and not used. tier="native" leaves out the three
    models that are fitted in Python. Cache eval_df where several of the five are read.
    """
    active, inactive = flag_inactive_items(df, date_col, id_col, value_col, inactive_weeks)
    eval_df, folds = evaluate_benchmarks(active, date_col, id_col, value_col, eval_window, tier=tier)
    best = select_best_fit(eval_df, id_col, primary_metric, secondary_metric, primary_weight, secondary_weight)
    return eval_df, best, forecast_winners(active, best, date_col, id_col, value_col, horizon, tier), inactive, folds


best_fit_pipeline_parallel = best_fit_pipeline
