"""Routed backtest detail: each series gets the models of its demand class; short series borrow from their group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import settled
from ..functions.registry import FITTED, get_models_for_category, order_of
from ..operators import gbt
from ..operators.classify import category_column
from ..operators.evaluate import fold_frame
from ..operators.fallback import NEW_ITEM_SHARE, aggregate_series, flat_forecast, group_calendar, item_shares
from ..operators.forecast import FORECASTS, with_forecasts
from ..operators.series import series_table
from ..schema import CATEGORIES, DATE, GRP, ID, group_key, normalise

GBT, GBT_FLAT = "gbt", "gbt_global_avg"
_ONE = "struct<model:string,model_ord:int,f:array<double>>"


def _routed(series: DataFrame, routed: Column, eval_window: int, kind: str, fitted: bool, trained) -> DataFrame:
    """Add the class and, where ``routed`` holds, the forecasts of its models; other rows get an empty array."""
    series = settled(series.withColumn("category", F.when(routed, category_column(F.col("y"))).otherwise("insufficient_history")))
    if kind == "gbt":
        return gbt.with_forecast(series, trained, eval_window, FORECASTS, GBT, F.col("category") != "insufficient_history")
    names: dict[str, list[str]] = {c: [m for m in get_models_for_category(c, kind) if fitted or m not in FITTED] for c in CATEGORIES}
    wanted = F.array().cast("array<string>")
    for category, own in names.items():
        wanted = F.when(F.col("category") == category, F.array(*[F.lit(m) for m in own])).otherwise(wanted)
    every = sorted({m for own in names.values() for m in own}, key=order_of)
    return with_forecasts(series.withColumn("__wanted", wanted), every, eval_window, wanted="__wanted").drop("__wanted")


def _folds(tested: DataFrame, id_col: str, method: Column) -> DataFrame:
    out = fold_frame(tested.withColumn("method", method), id_col, [F.col("category"), F.col("method")])
    return out.select(id_col, "model", "category", "fold", "date", "actual", "forecast", "method")


def _one(name: str, values: Column) -> Column:
    return F.array(F.struct(F.lit(name).alias("model"), F.lit(0).alias("model_ord"), values.alias("f"))).cast(f"array<{_ONE}>")


def generate_fold_details(
    df: DataFrame, date_col: str = "date", id_col: str = "item_id", value_col: str = "demand", group_col: str | Sequence[str] | None = None,
    eval_window: int = 52, min_train_weeks: int = 52, new_item_share: float = NEW_ITEM_SHARE, n_workers: int | None = None,
    kind: str = "full", fitted: bool = True, gbt_options: dict | None = None,
) -> DataFrame:
    """(id, model, category, fold, date, actual, forecast, method), one row per series, model and week of the holdout.

    kind: full (eight routed models), statistical (sba and stl_ses for every
    class) or gbt (one boosted-tree model over all series). Series of at
    least min_train_weeks + eval_window rows go direct. Shorter ones, down
    to eval_window rows, take their group's forecast times their share, or a
    flat mean without a group column or with a short group. Rows of a null
    group have no fallback; in a composite key a null reads None. n_workers
    is accepted and not used. fitted=False leaves Holt-Winters out.
    """
    least = min_train_weeks + eval_window
    columns = [group_col] if isinstance(group_col, str) else list(group_col or [])
    grouped = bool(columns) and all(c in df.columns for c in columns)
    key = None if not grouped else F.col(columns[0]).cast("string") if len(columns) == 1 else group_key(columns)
    rows = normalise(df, date_col, id_col, value_col, key).filter(F.col(DATE).isNotNull())
    plain = rows.select(ID, DATE, "__y")
    long_enough = F.col("n") >= least
    trained = None
    if kind == "gbt":
        trained = gbt.train(plain, eval_window, least=least, **(gbt_options or {}))

    flat_name = GBT_FLAT if kind == "gbt" else "global_avg"
    flat = _one(flat_name, flat_forecast(eval_window))
    # Every series in one pass, whatever becomes of it.
    profiles = kind != "gbt"
    tested = _routed(series_table(plain, eval_window, eval_window, profiles=profiles), long_enough, eval_window, kind, fitted, trained)
    if not grouped:
        both = tested.withColumn(FORECASTS, F.when(long_enough, F.col(FORECASTS)).otherwise(flat))
        return _folds(both, id_col, F.when(long_enough, "direct").otherwise("global_avg_fallback"))

    sums = aggregate_series(rows)
    calendar = group_calendar(sums, eval_window)
    short_ids = rows.groupBy(ID).agg(F.count(F.lit(1)).alias("n")).filter(~long_enough).select(ID)
    shares = item_shares(rows.join(short_ids, ID, "left_semi"), calendar, new_item_share)
    by_group = _routed(series_table(sums, eval_window, least, profiles=profiles), F.lit(True), eval_window, kind, fitted, trained).select(
        F.col(ID).alias(GRP), F.col("category").alias("__category"), F.col(FORECASTS).alias("__of_group"))
    # A group too short for models of its own has no row in by_group; a series of a null group has no share.
    lent = shares.join(by_group, GRP, "left").select(ID, "share", "__category", "__of_group")
    both = tested.join(lent, ID, "left").filter(long_enough | F.col("share").isNotNull())
    dealt = F.transform("__of_group", lambda x: F.struct(
        x["model"].alias("model"), x["model_ord"].alias("model_ord"), F.transform(x["f"], lambda v: F.greatest(v * F.col("share"), F.lit(0.0))).alias("f")))
    rich = F.col("__of_group").isNotNull()
    chosen = both.withColumns({
        FORECASTS: F.when(long_enough, F.col(FORECASTS)).when(rich, dealt).otherwise(flat),
        "category": F.when(~long_enough & rich, F.col("__category")).otherwise(F.col("category")),
    })
    return _folds(chosen, id_col, F.when(long_enough, "direct").when(rich, "aggregate_fallback").otherwise("global_avg_fallback"))
