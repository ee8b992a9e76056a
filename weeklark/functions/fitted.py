"""Models fitted in numpy, many series at once: additive Holt-Winters (plain and damped), theta, and STL with smoothing.

They follow the usual textbook forms. Parameters come from a coarse grid and
a local refinement of it, so values differ in detail from other packages.
``*_batch`` take lists of histories and of dates and return a row of
``horizon`` values for each series; they step over weeks once for all series
and all parameters. The functions without that suffix have the contract of
one series: f(history, dates, horizon=52, **kwargs) -> values.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

SEASON = 52
GRID = (0.05, 0.2, 0.5, 0.8)
#: Series and parameters that are stepped together, so that a batch's seasonals stay small.
TOGETHER = 16_384


def _filled(histories: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The histories as rows of one matrix, zeros behind their ends, and their lengths."""
    sizes = np.array([len(y) for y in histories])
    out = np.zeros((len(histories), int(sizes.max(initial=0))))
    for row, y in zip(out, histories, strict=True):
        row[:len(y)] = y
    return out, sizes


def _means(histories: Sequence[np.ndarray], horizon: int) -> np.ndarray:
    return np.array([np.full(horizon, float(np.mean(y)) if len(y) else np.nan) for y in histories]).reshape(len(histories), horizon)


def _fitted(histories: Sequence, horizon: int, season: int, fit: Callable[[list[np.ndarray], list[int]], np.ndarray], per_series: int) -> np.ndarray:
    """Means for series that are too short or constant, or whose fit is not finite; ``fit`` of the others, some at once."""
    ys = [np.asarray(y, float) for y in histories]
    out = _means(ys, horizon)
    able = [i for i, y in enumerate(ys) if len(y) >= 2 * season and float(np.std(y)) > 0.0]
    step = max(1, TOGETHER // per_series)
    for at in range(0, len(able), step):
        of = able[at:at + step]
        found = fit([ys[i] for i in of], of)
        fine = np.isfinite(found).all(axis=1)
        out[np.array(of)[fine]] = np.maximum(found[fine], 0.0)
    return out


def _smooth(y: np.ndarray, sizes: np.ndarray, season: int, params: np.ndarray):
    """All parameter rows (alpha, beta, gamma, phi) of all series at once: squared error, level, trend, seasonals by place in the cycle."""
    a, b, g, phi = np.moveaxis(params, -1, 0)
    first, second = y[:, :season].mean(axis=1), y[:, season:2 * season].mean(axis=1)
    level = np.repeat(first[:, None], params.shape[1], axis=1)
    trend = np.repeat(((second - first) / season)[:, None], params.shape[1], axis=1)
    seasonal = np.repeat((y[:, :season] - first[:, None]).T[:, :, None], params.shape[1], axis=2)
    error = np.zeros_like(level)
    shortest = int(sizes.min())
    for t in range(y.shape[1]):
        value, s = y[:, t, None], seasonal[t % season]
        ahead = level + phi * trend
        e = value - ahead - s
        new = a * (value - s) + (1 - a) * ahead
        turn = b * (new - level) + (1 - b) * phi * trend
        wave = g * (value - new) + (1 - g) * s
        if t < shortest:
            error += e * e
            seasonal[t % season], trend, level = wave, turn, new
        else:
            on = (t < sizes)[:, None]  # a series that has ended stays as it is
            error += np.where(on, e * e, 0.0)
            seasonal[t % season], trend, level = np.where(on, wave, s), np.where(on, turn, trend), np.where(on, new, level)
    return error, level, trend, seasonal


def _grid(damped: bool) -> np.ndarray:
    phis = (0.85, 0.95) if damped else (1.0,)
    return np.array([(a, b, g, p) for a in GRID for b in (0.01, 0.1, 0.3) for g in (0.05, 0.2, 0.5) for p in phis])


def _holt_winters(histories, horizon: int, season: int, damped: bool) -> np.ndarray:
    grid = _grid(damped)
    steps = np.arange(1, horizon + 1)

    def fit(ys: list[np.ndarray], _: list[int]) -> np.ndarray:
        y, sizes = _filled(ys)
        rows = np.arange(len(ys))
        params = np.broadcast_to(grid, (len(ys), *grid.shape))
        best = params[rows, _smooth(y, sizes, season, params)[0].argmin(axis=1)]
        for width in (0.5, 0.25):
            near = np.repeat(best[:, None], 1 + 2 * (4 if damped else 3), axis=1)
            for i in range(4 if damped else 3):
                for j, way in enumerate((1 - width, 1 + width)):
                    near[:, 1 + 2 * i + j, i] = np.minimum(best[:, i] * way, 0.98 if i == 3 else 0.99)
            best = near[rows, _smooth(y, sizes, season, near)[0].argmin(axis=1)]
        _, level, trend, seasonal = _smooth(y, sizes, season, best[:, None])
        phi = best[:, 3:]
        run = steps if not damped else phi * (1 - phi**steps) / (1 - phi)
        return level + run * trend + seasonal[(sizes[:, None] + steps - 1) % season, rows[:, None], 0]

    return _fitted(histories, horizon, season, fit, len(grid))


def holt_winters_batch(histories, dates, horizon: int = 52, season: int = SEASON) -> np.ndarray:
    return _holt_winters(histories, horizon, season, damped=False)


def damped_trend_seasonal_batch(histories, dates, horizon: int = 52, season: int = SEASON) -> np.ndarray:
    return _holt_winters(histories, horizon, season, damped=True)


def theta_batch(histories, dates, horizon: int = 52, season: int = SEASON) -> np.ndarray:
    """Additive season out, half the trend plus exponential smoothing, season back in."""
    alphas = np.linspace(0.05, 0.95, 19)
    steps = np.arange(1, horizon + 1)

    def fit(ys: list[np.ndarray], _: list[int]) -> np.ndarray:
        flats, slopes, effects = [], [], []
        for y in ys:
            t = np.arange(len(y))
            slope, start = np.polyfit(t, y, 1)
            detrended = y - (start + slope * t)
            effect = np.array([detrended[p::season].mean() for p in range(season)])
            effect -= effect.mean()
            effects.append(effect)
            flats.append(y - effect[t % season])
            slopes.append(np.polyfit(t, flats[-1], 1)[0])
        flat, sizes = _filled(flats)
        level = np.repeat(flat[:, :1], len(alphas), axis=1)
        error = np.zeros_like(level)
        for t in range(1, flat.shape[1]):
            on = (t < sizes)[:, None]
            e = np.where(on, flat[:, t, None] - level, 0.0)
            error += e * e
            level = level + alphas * e
        best = error.argmin(axis=1)
        alpha, n = alphas[best][:, None], sizes[:, None]
        drift = np.array(slopes)[:, None] / 2 * (steps - 1 + (1 - (1 - alpha) ** n) / alpha)
        return level[np.arange(len(ys)), best][:, None] + drift + np.array(effects)[np.arange(len(ys))[:, None], (n + steps - 1) % season]

    return _fitted(histories, horizon, season, fit, len(alphas))


def _loess(y: np.ndarray, span: int, weights: np.ndarray) -> np.ndarray:
    """Local lines with tricube weights at every point, for each row of ``y``."""
    n = y.shape[1]
    x = np.arange(n, dtype=float)
    q = min(span, n)
    lo = np.clip(np.arange(n) - q // 2, 0, n - q)
    idx = lo[:, None] + np.arange(q)
    d = np.abs(x[idx] - x[:, None])
    far = np.maximum(d.max(axis=1, keepdims=True), 1.0)
    w = (1 - np.minimum(d / far, 1) ** 3) ** 3 * weights[:, idx] + 1e-12
    at = y[:, idx]
    sw = w.sum(2)
    mx, my = (w * x[idx]).sum(2) / sw, (w * at).sum(2) / sw
    dx = x[idx] - mx[:, :, None]
    var = (w * dx * dx).sum(2)
    slope = np.where(var > 1e-9, (w * dx * (at - my[:, :, None])).sum(2) / np.maximum(var, 1e-9), 0.0)
    return my + slope * (x - mx)


def stl_seasonal(y: np.ndarray, season: int, outer: int = 2, inner: int = 2) -> np.ndarray:
    """Seasonal part of a robust decomposition by local regression."""
    n = len(y)
    trend, seasonal, weights = np.zeros(n), np.zeros(n), np.ones(n)
    # Weeks of the cycle by how many cycles they have: a matrix of places for each.
    places = [np.array([range(p, n, season) for p in of]) for of in (range(n % season), range(n % season, season)) if len(of)]
    for _ in range(outer):
        for _ in range(inner):
            free = y - trend
            for at in places:
                seasonal[at] = _loess(free[at], 7, weights[at])
            kernel = np.ones(season) / season
            before, after = season // 2, season - 1 - season // 2  # the ends go on with the cycle next to them
            wide = np.concatenate((seasonal[season - before:season], seasonal, seasonal[n - season:n - season + after]))
            low = np.convolve(wide, kernel, "valid")
            seasonal = seasonal - low
            trend = _loess((y - seasonal)[None], int(1.5 * season) | 1, weights[None])[0]
        rest = np.abs(y - trend - seasonal)
        h = 6 * np.median(rest)
        weights = (1 - np.minimum(rest / h, 1) ** 2) ** 2 if h > 0 else np.ones(n)
    return seasonal


def stl_ses_batch(histories, dates, horizon: int = 52, season: int = SEASON, alpha: float = 0.2) -> np.ndarray:
    """Smoothing of the demand without its season, plus the last cycle's season by ISO week."""
    import pandas as pd

    def fit(ys: list[np.ndarray], of: list[int]) -> np.ndarray:
        seasonals = [stl_seasonal(y, season) for y in ys]
        flat, sizes = _filled([y - s for y, s in zip(ys, seasonals, strict=True)])
        level = flat[:, 0]
        for t in range(1, flat.shape[1]):
            level = np.where(t < sizes, alpha * flat[:, t] + (1 - alpha) * level, level)
        out = []
        for i, value, seasonal in zip(of, level, seasonals, strict=True):
            days = pd.DatetimeIndex(pd.to_datetime(list(dates[i])))
            cycle = dict(zip(days.isocalendar().week.to_numpy()[-season:].tolist(), seasonal[-season:].tolist(), strict=True))
            start = days[-1] + pd.Timedelta(days=7)
            start += pd.Timedelta(days=(6 - start.weekday()) % 7)
            ahead = pd.date_range(start, periods=horizon, freq="7D").isocalendar().week.to_numpy().tolist()
            out.append(value + np.array([cycle.get(w, 0.0) for w in ahead]))
        return np.array(out)

    return np.maximum(_fitted(histories, horizon, season, fit, 64), 0.0)


def _single(batch: Callable) -> Callable:
    def one(history, dates, horizon: int = 52, **options) -> np.ndarray:
        return batch([history], [dates], horizon=horizon, **options)[0]

    one.__name__, one.__doc__ = batch.__name__.removesuffix("_batch"), batch.__doc__
    return one


holt_winters, damped_trend_seasonal, theta, stl_ses = map(_single, (holt_winters_batch, damped_trend_seasonal_batch, theta_batch, stl_ses_batch))
