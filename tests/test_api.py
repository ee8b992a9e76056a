import math

import numpy as np
import pytest

from weeklark import api


def test_all_names_exist():
    assert all(callable(getattr(api, name)) for name in api.__all__)


def test_metrics_of_one_history():
    assert api.calculate_wape([1, 3], [2, 2]) == 0.5 and api.calculate_wape([0, 0], [1, 1]) == math.inf and math.isnan(api.calculate_wape([1], [math.nan]))
    y = np.arange(60.0)
    assert api.calculate_mase([1, 2], [2, 4], y) == pytest.approx(1.5 / 52)
    assert api.calculate_mase([1], [2], y[:52]) == math.inf and api.calculate_mase([1], [2], np.ones(60)) == math.inf


def test_class_of_one_history():
    cases = {"intermittent": [0, 4, 0, 2], "lumpy": [0] * 10, "smooth": [5, 6, 5, 6], "erratic": [1, 30, 1, 2, 40, 1]}
    assert all(api.classify_history(y) == c for c, y in cases.items()) and api.classify_history([0] * 9 + [5]) == "intermittent"


def test_metrics_agree_with_the_backtest(weekly):
    rng = np.random.default_rng(1)
    y = rng.integers(1, 30, 150).astype(float)
    ev, folds = api.evaluate_benchmarks_parallel(weekly({"a": y}), "date", "item_id", "demand", names=["global_avg", "tsb"])
    f = {}
    for r in folds.orderBy("date").collect():
        f.setdefault(r["model"], []).append(r["forecast"])
    for r in ev.collect():
        assert r["wape"] == pytest.approx(api.calculate_wape(y[-52:], f[r["model"]]))
        assert r["mase"] == pytest.approx(api.calculate_mase(y[-52:], f[r["model"]], y[:-52]))
        assert r["fold_wapes"] == f"{r['wape']:.4f}"


def test_unknown_class_gets_all_models():
    assert set(api.get_models_for_category("none")) == {m for c in ("smooth", "erratic", "intermittent", "lumpy") for m in api.get_models_for_category(c)}
    assert api.get_models_for_category("smooth", "statistical") == ["sba", "stl_ses"]
