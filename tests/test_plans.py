import datetime as dt
import inspect
import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from weeklark import cli
from weeklark.functions import registry
from weeklark.operators import boost, gbt
from weeklark.operators.activity import flag_inactive_items
from weeklark.operators.diagnostics import get_diagnostics
from weeklark.operators.evaluate import evaluate_benchmarks, select_best_fit, summarize_results
from weeklark.operators.fallback import aggregate_series, group_calendar, item_shares
from weeklark.plans import queries
from weeklark.plans.pipeline import best_fit_pipeline
from weeklark.plans.routed import generate_fold_details
from weeklark.schema import ID, normalise

NAMES = ("date", "item_id", "demand")
EVAL = "item_id string, model string, wape double, mase double, total_actual double, total_forecast double, n_folds int, wape_std double, fold_wapes string"


def scores(spark, rows):
    return spark.createDataFrame([(i, m, float(w), float(s), 1.0, 1.0, 1, 0.0, "") for i, m, w, s in rows], EVAL)


def test_tournament_rules(spark):
    inf = math.inf
    best = {r["item_id"]: r for r in select_best_fit(scores(spark, [
        ("t", "seasonal_naive", 0.2, 1.0), ("t", "global_avg", 0.4, 0.5), ("t", "tsb", 0.3, 0.75),
        ("tie", "tsb", 0.5, 0.5), ("tie", "global_avg", 0.5, 0.5),
        ("inf", "tsb", inf, inf), ("inf", "seasonal_naive", inf, 1.0), ("nan", "imapa", math.nan, 1.0), ("nan", "tsb", math.nan, inf),
    ]), "item_id").collect()}
    assert (best["t"]["best_model"], best["t"]["selection_method"]) == ("seasonal_naive", "tournament")
    assert best["t"]["composite_score"] == pytest.approx(0.3)
    assert (best["tie"]["best_model"], best["tie"]["selection_method"], best["tie"]["composite_score"]) == ("global_avg", "tiebreak", 0.0)
    assert (best["inf"]["best_model"], best["inf"]["selection_method"]) == ("seasonal_naive", "fallback")
    assert math.isnan(best["inf"]["composite_score"])
    assert (best["nan"]["best_model"], best["nan"]["selection_method"]) == ("tsb", "fallback")


def test_104_weeks_always_fall_back(weekly):
    ev, folds = evaluate_benchmarks(weekly({"a": np.arange(104.0) + 1}), *NAMES)
    assert {r["mase"] for r in ev.collect()} == {math.inf}
    best = select_best_fit(ev, "item_id").collect()
    assert [(r["best_model"], r["selection_method"]) for r in best] == [("seasonal_naive", "fallback")]
    assert folds.count() == len(registry.TOURNAMENT) * 52


def test_pipeline_shapes(weekly):
    rng = np.random.default_rng(3)
    df = weekly({"a": rng.integers(0, 20, 160), "b": rng.integers(5, 9, 160), "dead": [3] * 120 + [0] * 40, "short": [1] * 60})
    ev, best, forecast, inactive, folds = best_fit_pipeline(df, *NAMES, horizon=10)
    assert {r["item_id"] for r in inactive.collect()} == {"dead", "short"}  # the short one ended long before the table does
    assert {r["item_id"] for r in best.collect()} == {"a", "b"}
    out = forecast.collect()
    assert len(out) == 20 and {r["step"] for r in out} == set(range(1, 11))
    assert ev.count() == 26 and folds.count() == 26 * 52
    won = {r["item_id"]: r["best_model"] for r in best.collect()}
    assert all(r["model"] == won[r["item_id"]] for r in out)
    summary = summarize_results(best, ev, "item_id").collect()
    assert sum(r["wins"] for r in summary) == 2 and sum(r["win_pct"] for r in summary) == pytest.approx(100)
    empties = best_fit_pipeline(df.limit(0), *NAMES)
    assert [e.count() for e in empties] == [0] * 5 and empties[0].columns == ev.columns


def test_fitted_tier_and_user_models(weekly):
    rng = np.random.default_rng(4)
    df = weekly({"a": rng.integers(1, 20, 170)})

    @registry.register_model("last_value")
    def last_value(history, dates, horizon=52, **_):
        assert len(dates) == len(history)
        return np.full(horizon, history[-1])

    @registry.register_model("broken")
    def broken(history, dates, horizon=52, **_):
        raise ValueError

    try:
        ev = {r["model"]: r for r in evaluate_benchmarks(df, *NAMES)[0].collect()}
    finally:
        registry.unregister_model("last_value")
        registry.unregister_model("broken")
    assert set(registry.TOURNAMENT) <= set(ev) and len(ev) == 15
    assert math.isfinite(ev["last_value"]["wape"]) and math.isnan(ev["broken"]["wape"])


def test_inactive_items(weekly):
    df = weekly({"on": [1] * 40, "off": [2] * 10 + [0] * 30, "back": [1] * 38 + [-4, 1], "never": [0] * 40})
    active, inactive = flag_inactive_items(df, *NAMES)
    assert {r["item_id"] for r in active.select("item_id").distinct().collect()} == {"on", "back"}
    found = {r["item_id"]: r for r in inactive.collect()}
    assert set(found) == {"off", "never"}
    assert (found["off"]["weeks_since_demand"], found["off"]["total_history_weeks"], found["off"]["lifetime_total_qty"]) == (30, 40, 20.0)
    assert found["never"]["weeks_since_demand"] is None
    assert flag_inactive_items(df, *NAMES, inactive_weeks=0)[1].count() == 0
    negative = weekly({"on": [1] * 40, "neg": [1] * 38 + [-30, 1]})
    a, i = flag_inactive_items(negative, *NAMES)
    assert {r["item_id"] for r in a.select("item_id").distinct().collect()} == {"on"} and i.count() == 0


def test_diagnostics(spark):
    day = dt.date(2024, 1, 1)
    rows = [(k, day + dt.timedelta(days=i), float(v) if v is not None else None) for k, vs in {
        "iqr4": [1, 2, 3, 10], "flat": [1, 1, 1], "zero": [0] * 5, "single": [0] * 9 + [5], "sparse": [0, 4, 0, 2]}.items() for i, v in enumerate(vs)]
    found = {r[0]: r for r in get_diagnostics(spark.createDataFrame([*rows, (None, day, 1.0)], "item_field string, date_field date, quantity_field double")).collect()}
    assert set(found) == {"iqr4", "flat", "zero", "single", "sparse"}
    assert found["iqr4"]["Flagged Outliers"] == "2024-01-04" and found["flat"]["Flagged Outliers"] == ""
    assert found["zero"]["Demand Pattern"] == "No Demand" and math.isnan(found["zero"]["ADI"])
    assert found["single"]["Demand Pattern"] == "Lumpy" and math.isnan(found["single"]["CV2"])
    assert (found["sparse"]["ADI"], found["sparse"]["Demand Pattern"]) == (2.0, "Intermittent")
    assert found["sparse"]["CV2"] == pytest.approx(2 / 9)


def shares_of(df, eval_window=4):
    rows = normalise(df, *NAMES, F.col("g0"))
    return {r[ID]: r["share"] for r in item_shares(rows, group_calendar(aggregate_series(rows), eval_window)).collect()}


def test_shares(weekly):
    g = dict.fromkeys("abc", ("g",))
    assert shares_of(weekly({"a": [0, 10, 20] + [0] * 4, "b": [0, 4, 6] + [0] * 4, "c": [0] * 7}, extra=g)) == pytest.approx({"a": 0.675, "b": 0.225, "c": 0.1})
    assert shares_of(weekly({"a": [0] * 7, "b": [0] * 7}, extra=g)) == {"a": 0.5, "b": 0.5}
    assert shares_of(weekly({"a": [3] * 7, "b": [1] * 7}, extra=g)) == pytest.approx({"a": 0.75, "b": 0.25})
    assert shares_of(weekly({"a": [-3] * 7, "b": [-1] * 7}, extra=g)) == pytest.approx({"a": 0.5, "b": 0.5})


def test_routed_details_and_fallbacks(weekly):
    rng = np.random.default_rng(5)
    series = {"long": rng.integers(5, 9, 120), "exact": [2.0, 4.0] * 26, "less": [1] * 51, "young": [0] * 40 + [3] * 20}
    df = weekly(series, extra={"long": ("g", "x"), "exact": ("g", "x"), "less": ("g", "x"), "young": (None, "x")})
    flat = generate_fold_details(df, fitted=False)
    rows = flat.filter("method <> 'direct'").collect()
    assert {r["item_id"] for r in rows} == {"exact", "young"} and len(rows) == 104
    assert {r["forecast"] for r in rows if r["item_id"] == "exact"} == {3.0}  # the mean of the test rows themselves
    assert {r["category"] for r in rows} == {"insufficient_history"}
    direct = flat.filter("method = 'direct'")
    assert {r["model"] for r in direct.select("model").distinct().collect()} == {"weekly_hist_avg", "weighted_seasonal_avg"}
    grouped = generate_fold_details(df, group_col="g0", fitted=False).filter("method <> 'direct'").collect()
    assert {(r["item_id"], r["method"]) for r in grouped} == {("exact", "aggregate_fallback")}  # a null group has no fallback
    both = generate_fold_details(df, group_col=["g0", "g1"], fitted=False).filter("method <> 'direct'").collect()
    assert {(r["item_id"], r["method"]) for r in both} == {("exact", "aggregate_fallback"), ("young", "global_avg_fallback")}
    stat = generate_fold_details(df, kind="statistical")
    assert {r["model"] for r in stat.filter("method = 'direct'").select("model").distinct().collect()} == {"sba", "stl_ses"}
    assert generate_fold_details(df.limit(0)).count() == 0


def test_trees_match_the_library(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rng = np.random.default_rng(6)
    x = rng.random((400, len(gbt.FEATURES)))
    y = x @ np.arange(len(gbt.FEATURES)) + x[:, 0] * x[:, 1]
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], [*gbt.FEATURES, "label"])
    rows = VectorAssembler(inputCols=list(gbt.FEATURES), outputCol="features").transform(df)
    model = GBTRegressor(maxIter=5, maxDepth=4, seed=1).fit(rows)
    own = gbt.parse_trees(model.toDebugString).predict(x)
    np.testing.assert_allclose(own, [r["prediction"] for r in model.transform(rows).select("prediction").collect()], rtol=1e-9)


def test_boosted_trees_end_to_end(weekly):
    rng = np.random.default_rng(7)
    df = weekly({k: rng.integers(5, 30, 150) for k in "abcd"})
    out = generate_fold_details(df, kind="gbt", gbt_options={"max_iter": 3})
    rows = out.collect()
    assert len(rows) == 4 * 52 and all(r["forecast"] >= 0 and math.isfinite(r["forecast"]) for r in rows) and {r["model"] for r in rows} == {"gbt"}
    short = generate_fold_details(weekly({"a": [1] * 104}), kind="gbt", gbt_options={"max_iter": 3}).collect()
    assert all(math.isnan(r["forecast"]) for r in short)


def test_cli_round_trip(spark, weekly, tmp_path):
    source, out = str(tmp_path / "in.csv"), str(tmp_path / "out")
    weekly({"a": np.arange(120.0)}).coalesce(1).write.option("header", True).csv(source)
    cli.main([source, "-o", out, "--kind", "statistical", "--single-file"], spark)
    back = spark.read.option("header", True).csv(out)
    assert back.count() == 104 and back.columns == ["item_id", "model", "category", "fold", "date", "actual", "forecast", "method"]


def test_weekly_stream(spark, tmp_path):
    from weeklark.schema import DATE, Y
    from weeklark.streaming.weekly import weekly_demand_stream, write_weekly

    t = dt.datetime
    rows = [("a", t(2024, 1, 1), 1.0), ("a", t(2024, 1, 7, 23), 2.0), ("a", t(2024, 1, 8), 5.0), ("b", t(2024, 3, 1), 1.0)]
    spark.createDataFrame(rows, "k string, ts timestamp, q double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp, q double").parquet(str(tmp_path / "in"))
    write_weekly(weekly_demand_stream(stream, F.col("k"), "ts", F.col("q")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {(r[ID], r[DATE], r[Y]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", dt.date(2024, 1, 7), 3.0), ("a", dt.date(2024, 1, 14), 5.0)}


def test_gbt_query_fits_all_trees_of_the_operator(spark, sf_dir, monkeypatch):
    kinds, asked = inspect.signature(gbt.train), []

    def train(*args, **options):
        found = kinds.bind(*args, **options)
        found.apply_defaults()
        asked.append(found.arguments["max_iter"])

    monkeypatch.setattr(gbt, "train", train)
    queries.gbt_forecast(spark, sf_dir)
    assert asked == [200]


def test_fold_wapes_round_the_exact_value(spark, weekly):
    """1/32 is a tie and goes to the even digit; the doubles of 0.00015 and 0.76625 are just under theirs."""
    cases = {"a": (1, 32), "b": (3, 20000), "c": (613, 800), "d": (1, 3), "e": (250, 2), "f": (0, 7), "g": (123456, 1), "h": (1, 20000), "i": (1599999, 1600000)}
    series = {k: [0] * 52 + [total + wrong] + [0] * 51 + [total] + [0] * 51 for k, (wrong, total) in cases.items()}
    rows = evaluate_benchmarks(weekly(series), *NAMES, names=["seasonal_naive"])[0].collect()
    assert {r["item_id"]: r["fold_wapes"] for r in rows} == {k: f"{wrong / total:.4f}" for k, (wrong, total) in cases.items()}


def test_win_shares_on_a_tie_go_up(spark):
    """1, 3 and 12 of 16 series: 6.25, 18.75 and 75 per cent, as SQL's round() shows them."""
    won = ["tsb"] + ["imapa"] * 3 + ["global_avg"] * 12
    e = scores(spark, [(f"s{i}", m, 0.5, 0.5) for i, m in enumerate(won)])
    got = {r["model"]: r["win_pct"] for r in summarize_results(select_best_fit(e, "item_id"), e, "item_id").collect()}
    assert got == {"tsb": 6.3, "imapa": 18.8, "global_avg": 75.0}


@pytest.fixture(scope="module")
def tree_rows(spark):
    """Three features of 9, 30 and 64 values, and a label that they don't explain wholly."""
    rng = np.random.default_rng(8)
    x = np.stack([rng.integers(0, k, 3000) for k in (9, 30, 64)], axis=1).astype(float)
    y = x[:, 0] * x[:, 1] + np.sin(x[:, 2]) * 20 + rng.normal(0, 5, len(x))
    return x, y, spark.createDataFrame(np.column_stack([x, y]).tolist(), "a double, b double, c double, y double").repartition(5)


@pytest.mark.parametrize("workers", [1, 3])
def test_trees_are_those_of_spark(spark, tree_rows, workers):
    """Without its random choices, the fit is GBTRegressor's, on one worker as on several."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    x, _, df = tree_rows
    rows = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df).withColumnRenamed("y", "label")
    model = GBTRegressor(maxIter=8, maxDepth=4, stepSize=0.1, minInstancesPerNode=20, maxBins=64, featureSubsetStrategy="all", seed=1).fit(rows)
    found = gbt.as_trees(boost.fit(df, 8, 4, 0.1, 20, rate=1.0, share=1.0, seed=1, workers=workers))
    assert found.predict(x) == pytest.approx(gbt.parse_trees(model.toDebugString).predict(x), abs=1e-8)


def test_trees_cost_no_jobs(spark, weekly):
    """The table is read for the candidates and dealt to the workers once, not scanned again for every level of every tree."""
    rng = np.random.default_rng(2)
    df = normalise(weekly({"a": rng.integers(0, 9, 260), "b": rng.integers(0, 9, 260)}), *NAMES)
    spark.sparkContext.setJobGroup("trees", "")
    try:
        assert len(gbt.train(df, 52, max_iter=30).roots) == 30
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("trees")) < 30
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_random_choices_repeat_and_every_row_counts(tree_rows):
    _, y, df = tree_rows
    one, two = (boost.fit(df, 3, 3, 0.1, 20, rate=0.8, share=0.8, seed=5, workers=2) for _ in range(2))
    assert one == two and one != boost.fit(df, 3, 3, 0.1, 20, rate=0.8, share=0.8, seed=6, workers=2)
    [(weight, [stump])] = boost.fit(df, 1, 0, 0.1, 20, rate=1.0, share=1.0, seed=5, workers=3)
    assert weight == 1.0 and stump[0] == -1 and stump[4] == pytest.approx(y.mean())


def test_quantiles_of_features_see_all_rows():
    """Thresholds of a feature of very many values cut the rows into near equal parts, whatever the parts they came in."""
    rng = np.random.default_rng(3)
    parts, values = [], []
    for k in range(7):
        x = rng.exponential(k + 1, 20_000 * (k + 1))
        values.append(x)
        v, c = boost._condensed(x, np.ones(len(x)), boost.POINTS)
        parts.append({"k": 0, "v": v, "c": c})
    [edges], rows = boost._edges(parts, 1)
    every = np.sort(np.concatenate(values))
    shares = np.diff(np.searchsorted(every, edges), prepend=0, append=len(every)) / len(every)
    assert rows == len(every) and len(edges) == 63 and np.abs(shares - 1 / 64).max() < 1 / 256


def test_trees_learn_from_long_series_only(weekly):
    df = normalise(weekly({"a": [1] * 200, "b": [1] * 199}), *NAMES)
    assert {(r[ID], r["t"]) for r in gbt.features(df, 52, 200).select(ID, "t").collect()} == {("a", t) for t in range(52, 148)}


def test_trees_refuse_null_demand(spark, weekly):
    df = normalise(weekly({"a": range(1, 200)}), *NAMES).withColumn("__y", F.when(F.col("__y") != 120, F.col("__y")))
    with pytest.raises(Exception, match="null or not finite"):
        gbt.train(df, 52, max_iter=2)


@pytest.mark.parametrize("gap", [1, 7, 10])
def test_python_models_get_the_dates_of_the_series(spark, gap):
    """Daily, weekly and gappy rows: the dates are those of the training rows."""
    start = dt.date(2020, 1, 5)
    days = [start + dt.timedelta(days=gap * i + (i // 20) * 14) for i in range(150)]
    df = spark.createDataFrame([("a", d, float(i)) for i, d in enumerate(days)], "item_id string, date date, demand double")

    @registry.register_model("days_back")
    def days_back(history, dates, horizon=52, **_):
        return np.full(horizon, float((dates[-1] - dates[0]) / np.timedelta64(1, "D")) + history[-1] / 1000 + len(dates) / 1e6)

    try:
        folds = evaluate_benchmarks(df, *NAMES, eval_window=20, min_train_weeks=30, names=["days_back"])[1]
        assert {r["forecast"] for r in folds.collect()} == {(days[129] - days[0]).days + 0.129 + 130 / 1e6}
    finally:
        registry.unregister_model("days_back")


def test_python_models_run_from_another_folder_without_the_subpackage(tmp_path):
    """A copy without the training-data folders, not on PYTHONPATH, used from elsewhere."""
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "weeklark", tmp_path / "lib" / "weeklark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    script = tmp_path / "run.py"
    script.write_text(
        "import sys, datetime as dt\n"
        f"sys.path.insert(0, {str(tmp_path / 'lib')!r})\n"
        "from pyspark.sql import SparkSession\n"
        "from weeklark.operators.evaluate import evaluate_benchmarks\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        "rows = [('a', dt.date(2020, 1, 5) + dt.timedelta(weeks=i), float(i % 7)) for i in range(160)]\n"
        "df = spark.createDataFrame(rows, 'item_id string, date date, demand double')\n"
        "print('models', evaluate_benchmarks(df, 'date', 'item_id', 'demand', names=['theta'])[0].count())\n")
    (tmp_path / "elsewhere").mkdir()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, str(script)], cwd=tmp_path / "elsewhere", env=env, capture_output=True, text=True, timeout=300, check=False)
    assert "models 1" in out.stdout, out.stderr[-2000:]
