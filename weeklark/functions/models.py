"""Forecast models that are expressions over a row of the series table.

Each takes the row's columns and a horizon and returns array<double> of
``horizon`` forecasts, NaN where the model does not apply. They run inside
the scan of the series table: no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .calendar import horizon_dates, iso_week
from .columns import at, let, nan, steps, total

SEASON = 52
ALPHA_TSB = 0.1
ALPHA_SBA = 0.1
ALPHA_BLOCKS = 0.2
BLOCK = 4
LEVELS = (1, 2, 4, 8, 13)
BLEND = 0.5
WEEKS = "__weeks"



def _y() -> Column:
    return F.col("y")


def _m() -> Column:
    return F.col("m")


def _flat(value: Column, h: int) -> Column:
    return let(value, lambda v: F.transform(F.sequence(F.lit(1), F.lit(h)), lambda s: v))


def _ahead(h: int, body: Callable[[Column, Column], Column]) -> Column:
    """body(ISO week, 0-based step) for every forecast week; the weeks are a column, ``horizon_weeks`` of the row."""
    return F.when(F.col("last").isNull(), _flat(nan(), h)).otherwise(F.transform(F.col(WEEKS), body))


def horizon_weeks(h: int) -> Column:
    return F.transform(horizon_dates(F.col("last"), h), iso_week)


def _by_week(profile: str, default: Column, h: int) -> Column:
    return let(default, lambda d: _ahead(h, lambda w, s: F.coalesce(at(F.col(profile), w - 1), d)))


def ses_level(xs: Column, alpha: float) -> Column:
    """Level of simple exponential smoothing, started at the first value; null for an empty array."""
    def folded(v: Column) -> Column:
        rest = F.slice(v, F.lit(2), F.greatest(F.size(v) - 1, F.lit(0)))
        return F.when(F.size(v) > 0, F.aggregate(rest, F.get(v, F.lit(0)), lambda level, x: alpha * x + (1 - alpha) * level))

    return let(xs, folded)


def seasonal_naive(h: int) -> Column:
    """The last 52 values again and again; shorter histories are tiled first."""
    tiled = _m() * (F.floor(SEASON / F.greatest(_m(), F.lit(1))) + 1)
    return F.when(_m() == 0, _flat(nan(), h)).otherwise(
        F.transform(F.sequence(F.lit(0), F.lit(h - 1)), lambda s: at(_y(), (tiled - SEASON + s % SEASON) % _m())))


def weekly_hist_avg(h: int) -> Column:
    return _by_week("week_mean", F.col("gmean"), h)


def global_avg(h: int) -> Column:
    return _flat(F.coalesce(F.col("gmean"), nan()), h)


def tsb(h: int, alpha_d: float = ALPHA_TSB, alpha_p: float = ALPHA_TSB) -> Column:
    """Demand size and demand probability, both smoothed; the probability decays in weeks without demand."""
    nonzero = F.filter(_y(), lambda v: v > 0)
    k = F.size(nonzero)
    start = F.struct(
        F.when(k > 0, total(nonzero) / F.greatest(k, F.lit(1))).otherwise(0.0).alias("z"), (k / F.greatest(_m(), F.lit(1))).cast("double").alias("p"))

    def step(a: Column, v: Column) -> Column:
        return F.struct(
            F.when(v > 0, alpha_d * v + (1 - alpha_d) * a["z"]).otherwise(a["z"]).alias("z"),
            ((1 - alpha_p) * a["p"] + F.when(v > 0, alpha_p).otherwise(0.0)).alias("p"))

    return F.when(_m() == 0, _flat(nan(), h)).otherwise(_flat(F.aggregate(_y(), start, step, lambda a: F.greatest(a["z"] * a["p"], F.lit(0.0))), h))


def _block_sums(size: int) -> Column:
    """Sums of blocks of ``size`` weeks, aligned to the newest week; the oldest rest is left out."""
    return F.transform(steps(F.floor(_m() / size)), lambda b: total(F.slice(_y(), _m() % size + b * size + 1, F.lit(size))))


def _index(h: int) -> Column:
    """Seasonal index of every forecast week; 1 for unseen weeks or without a positive mean."""
    overall = F.col("overall")
    return _ahead(h, lambda w, s: F.when(overall > 0, F.coalesce(at(F.col("week_mean"), w - 1) / F.nullif(overall, F.lit(0.0)), F.lit(1.0))).otherwise(1.0))


def _spread(amount: Column, size: int, index: Column, h: int) -> Column:
    """Deal a block's amount to its weeks by their indices; a short last block gets a whole amount too."""
    def body(w: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.lit((h - 1) // size)), lambda b: total(F.slice(w, b * size + 1, F.lit(size))))
        return let(sums, lambda ws: F.transform(w, lambda x, s: let(
            at(ws, F.floor(s / size)), lambda q: F.when(q > 0, x / F.nullif(q, F.lit(0.0)) * amount).otherwise(amount / size))))

    return let(index, body)


def temp_agg_ses(h: int, size: int = BLOCK, alpha: float = ALPHA_BLOCKS) -> Column:
    """Exponential smoothing of four-week sums, dealt back by the seasonal index; NaN under four weeks."""
    level = F.greatest(ses_level(_block_sums(size), alpha), F.lit(0.0))
    return F.when(_m() < size, _flat(nan(), h)).otherwise(let(level, lambda a: _spread(a, size, _index(h), h)))


def imapa(h: int, levels: tuple[int, ...] = LEVELS, alpha: float = ALPHA_BLOCKS) -> Column:
    """Mean over several block sizes of smoothed and dealt-back sums."""
    def one(size: int, index: Column) -> Column:
        level = F.greatest(ses_level(_block_sums(size), alpha), F.lit(0.0))
        return F.when(_m() >= size, let(level, lambda a: _spread(a, size, index, h)))

    def mean(index: Column) -> Column:
        return let(F.filter(F.array(*[one(size, index) for size in levels]), lambda f: f.isNotNull()), lambda fs: F.transform(
            F.sequence(F.lit(0), F.lit(h - 1)), lambda s: F.aggregate(fs, F.lit(0.0), lambda a, f: a + at(f, s)) / F.size(fs)))

    return F.when(_m() < min(levels), _flat(F.coalesce(F.col("gmean"), nan()), h)).otherwise(let(_index(h), mean))


def weighted_seasonal_avg(h: int) -> Column:
    return _by_week("week_weighted", F.col("gmean"), h)


def seasonal_median(h: int) -> Column:
    return _by_week("week_median", F.col("gmedian"), h)


def seasonal_naive_blend(h: int, share: float = BLEND) -> Column:
    return F.zip_with(seasonal_naive(h), weekly_hist_avg(h), lambda a, b: share * a + (1 - share) * b)


def linear_trend_seasonal(h: int) -> Column:
    """A line through the demand without its week effects, and the effects put back; never below zero."""
    gmean, n = F.col("gmean"), _m().cast("double")
    plain = F.zip_with(_y(), F.col("weeks"), lambda v, w: v - (at(F.col("week_mean"), w - 1) - gmean))
    mean_i = (n - 1) / 2
    var = n * (n * n - 1) / 12  # sum of squared deviations of 0 .. n-1

    def fitted(z: Column) -> Column:
        mean_z = total(z) / F.nullif(n, F.lit(0.0))
        cov = total(F.transform(z, lambda v, i: (i - mean_i) * v))
        line = F.struct(F.when(var > 0, cov / F.nullif(var, F.lit(0.0))).otherwise(0.0).alias("b"), mean_z.alias("z"))
        return let(line, lambda t: _ahead(h, lambda w, s: F.greatest(
            t["z"] + t["b"] * (n + s - mean_i) + F.coalesce(at(F.col("week_mean"), w - 1) - gmean, F.lit(0.0)), F.lit(0.0))))

    return F.when(_m() == 0, _flat(nan(), h)).otherwise(let(plain, fitted))


def sba(h: int, alpha_d: float = ALPHA_SBA, alpha_p: float = ALPHA_SBA) -> Column:
    """Smoothed size over smoothed interval of nonzero weeks, with the usual bias correction; 0 without demand."""
    start = F.struct(F.lit(-1.0).alias("z"), F.lit(0.0).alias("p"), F.lit(0).alias("gap"))

    def step(a: Column, v: Column) -> Column:
        gap = a["gap"] + 1
        first = a["z"] < 0
        hit = F.struct(
            F.when(first, v).otherwise(alpha_d * v + (1 - alpha_d) * a["z"]).alias("z"),
            F.when(first, gap.cast("double")).otherwise(alpha_p * gap + (1 - alpha_p) * a["p"]).alias("p"), F.lit(0).alias("gap"))
        miss = F.struct(a["z"].alias("z"), a["p"].alias("p"), gap.alias("gap"))
        return F.when(v > 0, hit).otherwise(miss)

    value = F.aggregate(_y(), start, step, lambda a: F.when(a["z"] < 0, 0.0).otherwise(
        F.greatest(a["z"] / F.nullif(a["p"], F.lit(0.0)) * (1 - alpha_p / 2), F.lit(0.0))))
    return F.when(_m() == 0, _flat(nan(), h)).otherwise(_flat(value, h))
