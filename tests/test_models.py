import datetime as dt
import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weeklark.functions import fitted, models
from weeklark.functions.registry import FITTED, TOURNAMENT
from weeklark.operators import gbt
from weeklark.operators.classify import category_column, classify_demand
from weeklark.operators.forecast import FORECASTS, with_forecasts
from weeklark.operators.series import densify_weekly, series_table
from weeklark.schema import DATE, ID, Y, normalise

NAMES = ("date", "item_id", "demand")
NATIVE = [m for m in TOURNAMENT if m not in FITTED] + ["sba"]


def forecasts(df, names, h=8, holdout=0):
    out = with_forecasts(series_table(normalise(df, *NAMES), holdout), names, h)
    return {r[ID]: {x["model"]: x["f"] for x in r[FORECASTS]} for r in out.collect()}


def weeks_of(start, n):
    return [(start + dt.timedelta(weeks=i)).isocalendar()[1] for i in range(n)]


def by_hand(y, start, h, name):
    """The models again, as plain loops."""
    y = np.array(y, float)
    n = len(y)
    wk = weeks_of(start, n)
    ahead = weeks_of(start + dt.timedelta(weeks=n), h)
    year = [(start + dt.timedelta(weeks=i)).year for i in range(n)]
    mean = {w: y[[i for i in range(n) if wk[i] == w]].mean() for w in set(wk)}
    overall = np.mean(list(mean.values()))
    index = [mean.get(w, overall) / overall if overall > 0 and w in mean else 1.0 for w in ahead]

    def ses(v, a):
        level = v[0]
        for x in v[1:]:
            level = a * x + (1 - a) * level
        return level

    def dealt(size):
        blocks = y[n % size:].reshape(-1, size).sum(axis=1)
        amount = max(ses(blocks, 0.2), 0)
        out = []
        for s in range(h):
            lo = s // size * size
            total = sum(index[lo:lo + size])
            out.append(index[s] / total * amount if total > 0 else amount / size)
        return out

    if name == "seasonal_naive":
        return [np.tile(y, 52 // n + 1)[-52:][s % 52] for s in range(h)]
    if name == "weekly_hist_avg":
        return [mean.get(w, y.mean()) for w in ahead]
    if name == "global_avg":
        return [y.mean()] * h
    if name == "tsb":
        z, p = (y[y > 0].mean() if (y > 0).any() else 0.0), (y > 0).mean()
        for v in y:
            z, p = (0.1 * v + 0.9 * z, 0.1 + 0.9 * p) if v > 0 else (z, 0.9 * p)
        return [max(z * p, 0)] * h
    if name == "temp_agg_ses":
        return dealt(4)
    if name == "imapa":
        return list(np.mean([dealt(s) for s in (1, 2, 4, 8, 13) if s <= n], axis=0))
    if name == "weighted_seasonal_avg":
        years = sorted(set(year))
        weight = [0.8 ** (len(years) - 1 - years.index(x)) for x in year]
        top = {w: sum(weight[i] * y[i] for i in range(n) if wk[i] == w) / sum(weight[i] for i in range(n) if wk[i] == w) for w in set(wk)}
        return [top.get(w, y.mean()) for w in ahead]
    if name == "seasonal_median":
        med = {w: np.median(y[[i for i in range(n) if wk[i] == w]]) for w in set(wk)}
        return [med.get(w, np.median(y)) for w in ahead]
    if name == "seasonal_naive_blend":
        return list((np.array(by_hand(y, start, h, "seasonal_naive")) + np.array(by_hand(y, start, h, "weekly_hist_avg"))) / 2)
    if name == "linear_trend_seasonal":
        z = np.array([y[i] - (mean[wk[i]] - y.mean()) for i in range(n)])
        b, a = np.polyfit(np.arange(n), z, 1) if n > 1 else (0.0, z[0])
        return [max(a + b * (n - 1 + s + 1) + (mean[w] - y.mean() if w in mean else 0.0), 0.0) for s, w in enumerate(ahead)]
    if name == "sba":
        z = p = None
        gap = 0
        for v in y:
            gap += 1
            if v > 0:
                z, p = (v, gap) if z is None else (0.1 * v + 0.9 * z, 0.1 * gap + 0.9 * p)
                gap = 0
        return [max(z / p * 0.95, 0) if z is not None else 0.0] * h
    raise KeyError(name)


@pytest.mark.parametrize("n", [5, 13, 60, 130])
def test_native_models_match_plain_loops(weekly, n):
    rng = np.random.default_rng(n)
    series = {"dense": rng.integers(1, 30, n), "sparse": rng.integers(0, 9, n) * (rng.random(n) < 0.3), "zero": np.zeros(n)}
    found = forecasts(weekly(series), NATIVE, h=55)
    for key, y in series.items():
        for name in NATIVE:
            np.testing.assert_allclose(found[key][name], by_hand(y, dt.date(2020, 1, 5), 55, name), rtol=1e-9, atol=1e-9, err_msg=f"{key} {name}")


def test_micro_fixtures(weekly):
    found = forecasts(weekly({"sparse4": [0, 4, 0, 2], "tile": [0, 1, 2, 3, 4], "n3": [1, 2, 3]}), ["tsb", "sba", "seasonal_naive", "temp_agg_ses"], h=5)
    assert found["sparse4"]["tsb"][0] == pytest.approx(1.5220595)
    assert found["sparse4"]["sba"][0] == pytest.approx(1.805)
    assert found["tile"]["seasonal_naive"][:4] == [3, 4, 0, 1]
    assert all(math.isnan(v) for v in found["n3"]["temp_agg_ses"])


def test_short_last_block_gets_a_whole_amount(weekly):
    f = forecasts(weekly({"a": [5.0] * 8}), ["temp_agg_ses"], h=5)["a"]["temp_agg_ses"]
    assert f == pytest.approx([5, 5, 5, 5, 20])


def test_ses_level(spark):
    level = spark.range(1).select(models.ses_level(F.array(F.lit(10.0), F.lit(20.0), F.lit(30.0)), 0.2).alias("l")).first()["l"]
    assert level == pytest.approx(15.6)


@pytest.mark.parametrize(("last", "first"), [(dt.date(2024, 1, 1), dt.date(2024, 1, 14)), (dt.date(2024, 1, 7), dt.date(2024, 1, 14))])
def test_horizon_snaps_to_sundays(spark, last, first):
    from weeklark.functions.calendar import horizon_dates

    days = spark.createDataFrame([(last,)], "d date").select(horizon_dates(F.col("d"), 3).alias("h")).first()["h"]
    assert days == [first + dt.timedelta(weeks=i) for i in range(3)]


def test_unseen_week_defaults(weekly):
    start = dt.date(2026, 1, 4)  # the 52nd row ends on 2026-12-27; the next Sunday is in ISO week 53
    y = np.arange(1.0, 53.0)
    f = forecasts(weekly({"a": y}, start=start), ["weekly_hist_avg", "seasonal_median"], h=1)["a"]
    assert f["weekly_hist_avg"] == pytest.approx([y.mean()])
    assert f["seasonal_median"] == pytest.approx([np.median(y)])


def test_empty_and_null_input(spark, weekly):
    empty = weekly({"a": [1.0]}).limit(0)
    assert with_forecasts(series_table(normalise(empty, *NAMES)), NATIVE, 4).count() == 0
    nulls = spark.createDataFrame([(None, dt.date(2020, 1, 5), 1.0)], "item_id string, date date, demand double")
    assert series_table(normalise(nulls, *NAMES)).count() == 0


def test_classes(weekly):
    df = weekly({"sparse4": [0, 4, 0, 2], "all_zero": [0] * 10, "single_nz": [0] * 9 + [5], "smooth": [5, 6, 5, 6, 5, 6], "erratic": [1, 30, 1, 2, 40, 1]})
    found = {r[ID]: r for r in classify_demand(normalise(df, *NAMES)).collect()}
    assert {k: r["category"] for k, r in found.items()} == {
        "sparse4": "intermittent", "all_zero": "lumpy", "single_nz": "intermittent", "smooth": "smooth", "erratic": "erratic"}
    assert found["sparse4"]["adi"] == 2.0 and found["sparse4"]["cv2"] == pytest.approx(1 / 9)
    from_array = {r[ID]: r["c"] for r in series_table(normalise(df, *NAMES)).select(ID, category_column(F.col("y")).alias("c")).collect()}
    assert from_array == {k: r["category"] for k, r in found.items()}


def test_densify(spark):
    d = lambda i: dt.date(2020, 1, 5) + dt.timedelta(weeks=i)
    df = spark.createDataFrame([("a", d(0), 1.0), ("a", d(3), 2.0), ("b", d(1), None), ("b", d(5), 4.0)], f"{ID} string, {DATE} date, {Y} double")
    rows = sorted((r[ID], r[DATE], r[Y]) for r in densify_weekly(df).collect())
    assert [(k, y) for k, _, y in rows] == [("a", 1), ("a", 0), ("a", 0), ("a", 2), ("a", 0), ("a", 0), ("b", 0), ("b", 0), ("b", 0), ("b", 0), ("b", 4)]
    assert rows[-1][1] == d(5)


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(0, 1e6), min_size=104, max_size=120))
def test_fitted_models_stay_finite_and_not_negative(y):
    dates = [dt.date(2020, 1, 5) + dt.timedelta(weeks=i) for i in range(len(y))]
    for f in (fitted.holt_winters, fitted.damped_trend_seasonal, fitted.theta, fitted.stl_ses):
        out = f(np.array(y), dates, horizon=10)
        assert out.shape == (10,) and np.isfinite(out).all() and (out >= 0).all()


def test_fitted_models_follow_a_clear_season():
    t = np.arange(208)
    y = 100 + 0.1 * t + 20 * np.sin(2 * np.pi * t / 52)
    dates = [dt.date(2018, 1, 7) + dt.timedelta(weeks=int(i)) for i in t]
    ahead = np.arange(208, 260)
    truth = 100 + 0.1 * ahead + 20 * np.sin(2 * np.pi * ahead / 52)
    for f in (fitted.holt_winters, fitted.damped_trend_seasonal, fitted.theta, fitted.stl_ses):
        assert np.abs(f(y, dates, horizon=52) - truth).mean() < 6
    assert (fitted.theta(y[:60], dates[:60], horizon=3) == y[:60].mean()).all()


def _plain_smooth(y, season, a, b, g, phi):
    level = sum(y[:season]) / season
    trend = (sum(y[season:2 * season]) / season - level) / season
    seasonal = [v - level for v in y[:season]]
    error = 0.0
    for t, v in enumerate(y):
        s = seasonal[t % season]
        ahead = level + phi * trend
        error += (v - ahead - s) ** 2
        new = a * (v - s) + (1 - a) * ahead
        trend = b * (new - level) + (1 - b) * phi * trend
        seasonal[t % season] = g * (v - new) + (1 - g) * s
        level = new
    return error, level, trend, seasonal


def _plain_holt_winters(y, horizon, season, damped):
    """One parameter set at a time, one week at a time."""
    grid = [(a, b, g, p) for a in fitted.GRID for b in (0.01, 0.1, 0.3) for g in (0.05, 0.2, 0.5) for p in ((0.85, 0.95) if damped else (1.0,))]
    best = min(grid, key=lambda q: _plain_smooth(y, season, *q)[0])
    for width in (0.5, 0.25):
        near = [best]
        for i in range(4 if damped else 3):
            for way in (1 - width, 1 + width):
                near.append(tuple(min(x * way, 0.98 if j == 3 else 0.99) if j == i else x for j, x in enumerate(best)))
        best = min(near, key=lambda q: _plain_smooth(y, season, *q)[0])
    _, level, trend, seasonal = _plain_smooth(y, season, *best)
    return [max(level + sum(best[3] ** k for k in range(0 if not damped else 1, h if not damped else h + 1)) * trend + seasonal[(len(y) + h - 1) % season], 0.0) for h in range(1, horizon + 1)]


def _plain_theta(y, horizon, season):
    n = len(y)
    slope, start = np.polyfit(range(n), y, 1)
    effect = [np.mean([y[t] - start - slope * t for t in range(p, n, season)]) for p in range(season)]
    mean = sum(effect) / season
    flat = [y[t] - (effect[t % season] - mean) for t in range(n)]
    slope = np.polyfit(range(n), flat, 1)[0]
    tried = []
    for alpha in np.linspace(0.05, 0.95, 19):
        level, error = flat[0], 0.0
        for v in flat[1:]:
            error += (v - level) ** 2
            level += alpha * (v - level)
        tried.append((error, alpha, level))
    _, alpha, level = min(tried)
    return [max(level + slope / 2 * (h - 1 + (1 - (1 - alpha) ** n) / alpha) + effect[(n + h - 1) % season] - mean, 0.0) for h in range(1, horizon + 1)]


def _plain_loess(y, span, weights):
    n, out = len(y), []
    for i in range(n):
        q = min(span, n)
        lo = min(max(i - q // 2, 0), n - q)
        far = max(max(abs(j - i) for j in range(lo, lo + q)), 1.0)
        w = [(1 - min(abs(j - i) / far, 1) ** 3) ** 3 * weights[j] + 1e-12 for j in range(lo, lo + q)]
        mx = sum(a * j for a, j in zip(w, range(lo, lo + q))) / sum(w)
        my = sum(a * y[j] for a, j in zip(w, range(lo, lo + q))) / sum(w)
        var = sum(a * (j - mx) ** 2 for a, j in zip(w, range(lo, lo + q)))
        slope = sum(a * (j - mx) * (y[j] - my) for a, j in zip(w, range(lo, lo + q))) / var if var > 1e-9 else 0.0
        out.append(my + slope * (i - mx))
    return out


def _plain_stl(y, season):
    n = len(y)
    trend, weights, seasonal = [0.0] * n, [1.0] * n, [0.0] * n
    for _ in range(2):
        for _ in range(2):
            for p in range(season):
                for t, v in zip(range(p, n, season), _plain_loess([y[t] - trend[t] for t in range(p, n, season)], 7, weights[p::season])):
                    seasonal[t] = v
            wide = seasonal[season - season // 2:season] + seasonal + seasonal[n - season:n - season + season - 1 - season // 2]
            seasonal = [seasonal[t] - sum(wide[t:t + season]) / season for t in range(n)]
            trend = _plain_loess([a - b for a, b in zip(y, seasonal)], int(1.5 * season) | 1, weights)
        rest = [abs(a - b - c) for a, b, c in zip(y, trend, seasonal)]
        h = 6 * float(np.median(rest))
        weights = [(1 - min(r / h, 1) ** 2) ** 2 if h else 1.0 for r in rest]
    return seasonal


def test_fitted_batches_match_plain_loops():
    """Series of several lengths, some too short or constant, in one batch."""
    r = np.random.default_rng(3)
    season, horizon = 12, 15
    ys = [np.maximum(r.normal(20 + 6 * np.sin(2 * np.pi * np.arange(n) / season) + 0.05 * np.arange(n), 3), 0) for n in (24, 31, 60, 61, 85)]
    ys += [np.where(r.random(50) < 0.7, 0.0, ys[2][:50]), np.full(40, 7.0), np.arange(5.0), np.zeros(0)]
    dates = [[dt.date(2021, 1, 3) + dt.timedelta(weeks=i) for i in range(len(y))] for y in ys]
    plain = {
        "holt_winters": lambda y: _plain_holt_winters(y, horizon, season, False), "damped_trend_seasonal": lambda y: _plain_holt_winters(y, horizon, season, True),
        "theta": lambda y: _plain_theta(y, horizon, season),
    }
    for name, f in plain.items():
        got = getattr(fitted, f"{name}_batch")(ys, dates, horizon=horizon, season=season)
        assert got.shape == (len(ys), horizon)
        for y, row in zip(ys[:6], got):
            np.testing.assert_allclose(row, f(y.tolist()), rtol=1e-7, atol=1e-7)
        assert (got[6] == 7).all() and (got[7] == 2).all() and np.isnan(got[8]).all()
    for y in ys[:6]:
        np.testing.assert_allclose(fitted.stl_seasonal(y, season), _plain_stl(y.tolist(), season), rtol=1e-6, atol=1e-6)
    got = fitted.stl_ses_batch(ys, dates, horizon=horizon, season=season)
    for y, days, row in zip(ys[:6], dates, got):
        seasonal = _plain_stl(y.tolist(), season)
        level = y[0] - seasonal[0]
        for v, s in zip(y[1:], seasonal[1:]):
            level = 0.2 * (v - s) + 0.8 * level
        cycle = {d.isocalendar()[1]: s for d, s in list(zip(days, seasonal))[-season:]}
        want = [max(level + cycle.get((days[-1] + dt.timedelta(weeks=k)).isocalendar()[1], 0.0), 0.0) for k in range(1, horizon + 1)]
        np.testing.assert_allclose(row, want, rtol=1e-6, atol=1e-6)


def test_trees_match_a_plain_walk():
    """Recursive forecasts of a small ensemble, one series and one step at a time."""
    text = ("GBTRegressionModel\n  Tree 0 (weight 1.0):\n    If (feature 0 <= 2.5)\n     If (feature 8 <= 20.0)\n      Predict: 1.5\n     Else (feature 8 > 20.0)\n      Predict: 4.0\n"
            "    Else (feature 0 > 2.5)\n     Predict: 3.0\n  Tree 1 (weight 0.5):\n    If (feature 5 <= 2.0)\n     Predict: -1.0\n    Else (feature 5 > 2.0)\n     Predict: 2.0\n")
    trees = gbt.parse_trees(text)

    def value(x):
        return (3.0 if x[0] > 2.5 else 1.5 if x[8] <= 20 else 4.0) + 0.5 * (-1.0 if x[5] <= 2 else 2.0)

    r = np.random.default_rng(5)
    histories = [r.integers(0, 6, n).astype(float) for n in (60, 104, 3)] + [np.zeros(70)]
    weeks = np.array([[(k + j) % 52 + 1 for j in range(30)] for k in range(4)])
    got = gbt.predict_batch(trees, histories, weeks, np.ones((4, 30)))
    for y, w, row in zip(histories, weeks, got):
        run = y.tolist()
        for step in range(30):
            x = [0.0] * 14
            x[0], x[5], x[8] = run[-1], sum(run[-4:]) / min(len(run), 4), w[step]
            run.append(max(value(x), 0.0))
        np.testing.assert_allclose(row, run[len(y):])
