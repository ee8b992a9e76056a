"""Registered queries over the test tables; ``oracle`` holds the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import horizon_dates, iso_week
from ..functions.registry import FITTED, TOURNAMENT
from ..operators import gbt
from ..operators.activity import flag_inactive_items
from ..operators.classify import classify_demand, route_models
from ..operators.diagnostics import get_diagnostics
from ..operators.evaluate import evaluate_benchmarks, select_best_fit, summarize_results
from ..operators.fallback import aggregate_series, group_calendar, item_shares
from ..operators.forecast import FORECASTS, with_forecasts
from ..operators.series import series_table
from ..schema import DATE, GRP, ID, Y, group_key, normalise
from ..sources.tables import event_days, named, part_weeks, part_weeks_grouped, supplier_weeks
from .pipeline import best_fit_pipeline, forecast_winners
from .routed import generate_fold_details

HOLDOUT = 52
#: Rows below which a part is short in the fallback queries.
SHORT_TRAIN = 250
#: More training rows than any group of the test tables has.
LONGER_THAN_ALL = 400
NATIVE = tuple(m for m in TOURNAMENT if m not in FITTED)

_COLUMNS = ("date", "item_id", "demand")


def _r(c: str, digits: int = 4):
    return F.round(c, digits).alias(c)


def weekly_densify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(supplier_weeks(spark, sf_dir)).select("item_id", "date", "demand")


def inactive_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag_inactive_items(named(part_weeks(spark, sf_dir)), *_COLUMNS)[1]


def active_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    active, _ = flag_inactive_items(named(part_weeks(spark, sf_dir)), *_COLUMNS)
    return active.groupBy("item_id").agg(F.count(F.lit(1)).alias("weeks"), F.sum("demand").alias("demand"))


def demand_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_demand(part_weeks(spark, sf_dir), HOLDOUT).select(F.col(ID).alias("item_id"), _r("adi", 6), _r("cv2", 6), "category")


def routed_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    classified = classify_demand(part_weeks(spark, sf_dir), HOLDOUT)
    return route_models(classified).select(F.col(ID).alias("item_id"), "category", "model")


def _diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return get_diagnostics(event_days(spark, sf_dir))


def diagnostics_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _diagnostics(spark, sf_dir)
    safe = lambda c: F.when(F.isnan(c), F.lit(-1.0)).otherwise(F.round(c, 6)).alias(c)
    return d.select(F.col("Forecast Series").alias("item_field"), safe("ADI"), safe("CV2"), F.col("Demand Pattern").alias("pattern"))


def diagnostics_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diagnostics(spark, sf_dir).select(F.col("Forecast Series").alias("item_field"), F.col("Flagged Outliers").alias("outliers"))


def _forecast(spark: SparkSession, sf_dir: str, name: str, source=supplier_weeks) -> DataFrame:
    run = with_forecasts(series_table(source(spark, sf_dir), HOLDOUT), [name], HOLDOUT)
    out = run.select(F.col(ID).alias("item_id"), F.explode(FORECASTS).alias("x")).select("item_id", F.posexplode("x.f").alias("at", "forecast"))
    return out.select("item_id", (F.col("at") + 1).alias("step"), _r("forecast"))


def _model_query(name: str, source=supplier_weeks) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _forecast(spark, sf_dir, name, source)


def seasonal_index_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series_table(supplier_weeks(spark, sf_dir), HOLDOUT)
    weeks = s.select(F.col(ID).alias("item_id"), "overall", F.posexplode(F.arrays_zip("week_mean", "week_median", "week_weighted")).alias("at", "p")).filter("p.week_mean is not null")
    return weeks.select(
        "item_id", (F.col("at") + 1).alias("iso_week"), F.round("p.week_mean", 4).alias("mean"), F.round("p.week_median", 4).alias("median"),
        F.round("p.week_weighted", 4).alias("weighted"), F.round(F.col("p.week_mean") / F.col("overall"), 6).alias("seasonal_index"))


def horizon_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = supplier_weeks(spark, sf_dir).groupBy(ID).agg(F.max(DATE).alias("last"))
    days = last.select(F.col(ID).alias("item_id"), F.posexplode(horizon_dates(F.col("last"), HOLDOUT)).alias("at", "date"))
    return days.select("item_id", (F.col("at") + 1).alias("step"), "date", iso_week(F.col("date")).alias("iso_week"))


def _evaluated(spark: SparkSession, sf_dir: str, tier: str = "native") -> tuple[DataFrame, DataFrame]:
    """By default of the ten models that SQL can express; ``*_full`` queries run all thirteen."""
    return evaluate_benchmarks(named(supplier_weeks(spark, sf_dir)), *_COLUMNS, tier=tier)


def wape_mase(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _evaluated(spark, sf_dir)[0]
    return e.select("item_id", "model", _r("wape", 6), _r("mase", 6), _r("total_actual"), _r("total_forecast"), "n_folds", "wape_std")


def tournament(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = select_best_fit(_evaluated(spark, sf_dir)[0], "item_id")
    return best.select("item_id", "best_model", _r("composite_score", 6), _r("wape", 6), _r("mase", 6), "selection_method")


def fold_wapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir)[0].select("item_id", "model", "fold_wapes")


def summary_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _evaluated(spark, sf_dir)[0]
    s = summarize_results(select_best_fit(e, "item_id"), e, "item_id")
    return s.select("model", "wins", "win_pct", _r("median_wape", 6), _r("median_mase", 6), _r("demand_weighted_wape", 6), "median_wape_std")


def fold_details_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir)[1].select("item_id", "model", "fold", "date", "actual", _r("forecast"))


def _final(spark: SparkSession, sf_dir: str, tier: str) -> DataFrame:
    df = named(supplier_weeks(spark, sf_dir))
    best = select_best_fit(evaluate_benchmarks(df, *_COLUMNS, tier=tier)[0], "item_id")
    return forecast_winners(df, best, *_COLUMNS, tier=tier).select("item_id", "model", "date", _r("forecast"), "step")


def final_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _final(spark, sf_dir, "native")


def final_forecast_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _final(spark, sf_dir, "full")


def pipeline_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline over parts, inactive ones filtered: the winners."""
    best = best_fit_pipeline(named(part_weeks(spark, sf_dir)), *_COLUMNS, tier="native")[1]
    return best.select("item_id", "best_model", "selection_method")


def pipeline_parts_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = best_fit_pipeline(named(part_weeks(spark, sf_dir)), *_COLUMNS)[1]
    return best.select("item_id", "best_model", "selection_method")


def _routed(spark: SparkSession, sf_dir: str, fitted: bool) -> DataFrame:
    d = generate_fold_details(named(supplier_weeks(spark, sf_dir)), fitted=fitted)
    return d.select("item_id", "model", "category", "date", "actual", _r("forecast"), "method")


def fold_details_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without Holt-Winters, which SQL can't express."""
    return _routed(spark, sf_dir, fitted=False)


def fold_details_routed_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir, fitted=True)


def routed_models_statistical(spark: SparkSession, sf_dir: str) -> DataFrame:
    classified = classify_demand(part_weeks(spark, sf_dir), HOLDOUT)
    return route_models(classified, "statistical").select(F.col(ID).alias("item_id"), "category", "model")


def _short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_weeks_grouped(spark, sf_dir)


def aggregate_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = generate_fold_details(_short(spark, sf_dir), group_col="p_brand", min_train_weeks=SHORT_TRAIN, fitted=False)
    return d.filter(F.col("method") == "aggregate_fallback").select("item_id", "model", "category", "date", "actual", _r("forecast"))


def aggregate_fallback_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate_fold_details(_short(spark, sf_dir), group_col=["p_brand", "p_type"], min_train_weeks=SHORT_TRAIN)


def aggregate_too_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that have too little history themselves: their items get flat means."""
    d = generate_fold_details(_short(spark, sf_dir), group_col="p_brand", min_train_weeks=LONGER_THAN_ALL, fitted=False)
    return d.select("item_id", "model", "category", "date", "actual", _r("forecast"), "method")


def global_avg_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = generate_fold_details(_short(spark, sf_dir), min_train_weeks=SHORT_TRAIN, fitted=False)
    return d.filter(F.col("method") == "global_avg_fallback").select("item_id", "model", "category", "date", "actual", _r("forecast"))


def brand_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normalise(_short(spark, sf_dir), *_COLUMNS, F.col("p_brand"))
    return aggregate_series(rows).select(F.col(ID).alias("p_brand"), F.col(DATE).alias("date"), F.col(Y).alias("demand"))


def shares_of_short_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normalise(_short(spark, sf_dir), *_COLUMNS, F.col("p_type"))
    counts = rows.groupBy(ID).agg(F.count(DATE).alias("k")).filter(F.col("k") < SHORT_TRAIN + HOLDOUT)
    shares = item_shares(rows.join(counts.select(ID), ID, "left_semi"), group_calendar(aggregate_series(rows), HOLDOUT))
    return shares.select(F.col(GRP).alias("p_type"), F.col(ID).alias("item_id"), "recent", _r("share", 6))


def shares_of_returned_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demand less one a week: many items have negative sums, which take equal shares."""
    rows = normalise(_short(spark, sf_dir).withColumn("demand", F.col("demand") - 1.0), *_COLUMNS, F.col("p_type"))
    counts = rows.groupBy(ID).agg(F.count(DATE).alias("k")).filter(F.col("k") < SHORT_TRAIN + HOLDOUT)
    shares = item_shares(rows.join(counts.select(ID), ID, "left_semi"), group_calendar(aggregate_series(rows), HOLDOUT))
    return shares.select(F.col(GRP).alias("p_type"), F.col(ID).alias("item_id"), "recent", _r("share", 6))


def composite_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _short(spark, sf_dir).withColumn("grp", group_key(["p_brand", "p_type"]))
    return df.groupBy("grp").agg(F.countDistinct("item_id").alias("items"), F.sum("demand").alias("demand"))


def gbt_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = gbt.features(supplier_weeks(spark, sf_dir), HOLDOUT)
    return f.select(F.col(ID).alias("item_id"), F.col(DATE).alias("date"), F.col(Y).alias("demand"), *[_r(c) for c in gbt.FEATURES])


def gbt_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate_fold_details(named(supplier_weeks(spark, sf_dir)), kind="gbt")


def statistical_fold_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate_fold_details(named(supplier_weeks(spark, sf_dir)), kind="statistical")


def tournament_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_best_fit(_evaluated(spark, sf_dir, "full")[0], "item_id")


def adhoc_mae_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten series with the largest mean absolute error of the flat mean; a report, so it is limited."""
    e = _evaluated(spark, sf_dir)[1].filter(F.col("model") == "global_avg")
    mae = e.groupBy("item_id").agg(F.round(F.avg(F.abs(F.col("actual") - F.col("forecast"))), 4).alias("mae"))
    return mae.orderBy(F.col("mae").desc(), "item_id").limit(10)


def adhoc_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _evaluated(spark, sf_dir)[1]
    return e.groupBy("model").agg(F.round(F.sqrt(F.avg(F.pow(F.col("actual") - F.col("forecast"), 2))), 4).alias("rmse"))


def adhoc_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _evaluated(spark, sf_dir)[1]
    bias = e.groupBy("item_id", "model").agg(F.round(F.avg(F.col("forecast") - F.col("actual")), 4).alias("bias"))
    return bias.filter(F.abs("bias") > 5).orderBy("bias", "item_id", "model")


def model_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value counts of the winners."""
    return select_best_fit(_evaluated(spark, sf_dir)[0], "item_id").groupBy("best_model").agg(F.count(F.lit(1)).alias("series")).orderBy(F.col("series").desc(), "best_model")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "weekly_densify": weekly_densify, "inactive_items": inactive_items, "active_items": active_items, "classify_demand": demand_classes,
    "route_models": routed_models, "diagnostics_pattern": diagnostics_pattern, "diagnostics_outliers": diagnostics_outliers,
    **{name: _model_query(name) for name in NATIVE}, "sba": _model_query("sba"),
    "tsb_parts": _model_query("tsb", part_weeks), "sba_parts": _model_query("sba", part_weeks),
    "seasonal_index_profile": seasonal_index_profile, "horizon_calendar": horizon_calendar, "wape_mase": wape_mase, "tournament": tournament,
    "summary_by_model": summary_by_model, "fold_wapes": fold_wapes,
    "fold_details_pipeline": fold_details_pipeline, "final_forecast": final_forecast, "final_forecast_full": final_forecast_full,
    "pipeline_parts": pipeline_parts, "pipeline_parts_full": pipeline_parts_full, "fold_details_routed": fold_details_routed,
    "fold_details_routed_full": fold_details_routed_full, "route_models_statistical": routed_models_statistical, "aggregate_fallback": aggregate_fallback,
    "aggregate_fallback_full": aggregate_fallback_full, "aggregate_too_short": aggregate_too_short, "item_shares_signed": shares_of_returned_items,
    "global_avg_fallback": global_avg_fallback, "aggregate_series": brand_series, "item_shares": shares_of_short_items,
    "composite_group_key": composite_group, "gbt_features": gbt_features, "gbt_forecast": gbt_forecast,
    **{name: _model_query(name) for name in (*FITTED, "stl_ses")},
    "statistical_fold_details": statistical_fold_details, "tournament_full": tournament_full,
    "adhoc_mae_topk": adhoc_mae_topk, "adhoc_rmse": adhoc_rmse, "adhoc_bias": adhoc_bias, "model_counts": model_counts,
}
