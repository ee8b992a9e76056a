"""Metrics and the demand class of one history, for use outside a query."""

from __future__ import annotations

import numpy as np

from .columns import INF

# Class limits.
ADI_LIMIT, CV2_LIMIT = 1.32, 0.49


def calculate_wape(actual, forecast) -> float:
    """Absolute error over absolute demand; infinite for no demand."""
    a, f = np.asarray(actual, float), np.asarray(forecast, float)
    size = np.abs(a).sum()
    return float(np.abs(a - f).sum() / size) if size else INF


def calculate_mase(actual, forecast, in_sample, seasonal_period: int = 52) -> float:
    """Mean absolute error over that of the seasonal naive forecast in the sample; infinite where that is none or zero."""
    y = np.asarray(in_sample, float)
    if len(y) <= seasonal_period:
        return INF
    naive = np.abs(y[seasonal_period:] - y[:-seasonal_period]).mean()
    return float(np.abs(np.asarray(actual, float) - np.asarray(forecast, float)).mean() / naive) if naive else INF


def classify_history(history) -> str:
    """smooth, erratic, intermittent or lumpy."""
    y = np.asarray(history, float)
    places = np.flatnonzero(y > 0)
    if not len(places):
        return "lumpy"
    sizes = y[places]
    adi = (places[-1] - places[0]) / (len(places) - 1) if len(places) > 1 else float(len(y))
    spread = (sizes.std() / sizes.mean()) ** 2 > CV2_LIMIT
    return ("erratic" if spread else "smooth") if adi <= ADI_LIMIT else ("lumpy" if spread else "intermittent")
