"""One boosted-tree model over all series: features, training, and recursive forecasts.

Features of a row see only the rows before it. The statistics of a series
are those of its first 26*floor(t/26) rows, so they change every 26 rows.
Forecasts feed back step by step; each step predicts for all series of an
Arrow batch at once, with the trees as arrays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions.calendar import horizon_dates, iso_week
from ..schema import DATE, ID, Y, ensure_importable
from . import boost
from .series import indexed

# The features in order, lags and rolling widths.
LAGS = (1, 4, 13, 26, 52)
FEATURES = (
    "lag_1", "lag_4", "lag_13", "lag_26", "lag_52", "rolling_mean_4", "rolling_mean_13", "rolling_std_4", "week_of_year", "month",
    "historical_mean", "historical_cv", "adi", "demand_ratio",
)
FIRST_ROW, REFRESH = 52, 26


def _cv(k: Column, s: Column, q: Column) -> Column:
    mean = s / F.nullif(k, F.lit(0))
    var = F.greatest(q / F.nullif(k, F.lit(0)) - mean * mean, F.lit(0.0))
    return F.when((k > 1) & (mean > 0), F.sqrt(var) / F.nullif(mean, F.lit(0.0))).otherwise(0.0)


def features(df: DataFrame, holdout: int = 0, least: int = 0) -> DataFrame:
    """(id, date, t, y, the features) for rows t >= 52 of the part before the holdout, of series of ``least`` rows. Needs internal names; one shuffle."""
    rows = indexed(df).filter((F.col("i") < F.col("n") - holdout) & (F.col("n") >= least))
    order = Window.partitionBy(ID).orderBy("i")
    before = lambda k: order.rowsBetween(-k, -1)
    prefix = order.rowsBetween(Window.unboundedPreceding, -1)
    y = F.col(Y)
    nz = lambda c: F.when(y > 0, c)
    cols = {f"lag_{k}": F.lag(Y, k, 0.0).over(order) for k in LAGS}
    cols |= {f"rolling_mean_{k}": F.coalesce(F.avg(Y).over(before(k)), F.lit(0.0)) for k in (4, 13)}
    cols["rolling_std_4"] = F.coalesce(F.stddev_pop(Y).over(before(4)), F.lit(0.0))
    cols |= {"__s": F.sum(Y).over(prefix), "__k": F.count(nz(y)).over(prefix), "__z": F.sum(nz(y)).over(prefix),
             "__q": F.sum(nz(y * y)).over(prefix), "__lo": F.min(nz(F.col("i"))).over(prefix), "__hi": F.max(nz(F.col("i"))).over(prefix)}
    wide = rows.withColumns(cols)
    i, k = F.col("i"), F.col("__k")
    stats = F.struct(
        (F.col("__s") / F.nullif(i, F.lit(0))).alias("mean"), _cv(k, F.col("__z"), F.col("__q")).alias("cv"),
        F.when(k > 1, (F.col("__hi") - F.col("__lo")) / F.nullif(k - 1, F.lit(0))).otherwise(i.cast("double")).alias("adi"),
        (k / F.nullif(i, F.lit(0))).alias("ratio"))
    anchored = wide.withColumn("__stats", F.last(F.when(i % REFRESH == 0, stats), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return anchored.filter(i >= FIRST_ROW).select(
        ID, DATE, i.alias("t"), Y, *[f"lag_{k}" for k in LAGS], "rolling_mean_4", "rolling_mean_13", "rolling_std_4",
        iso_week(F.col(DATE)).cast("double").alias("week_of_year"), F.month(DATE).cast("double").alias("month"),
        F.col("__stats.mean").alias("historical_mean"), F.col("__stats.cv").alias("historical_cv"), F.col("__stats.adi").alias("adi"), F.col("__stats.ratio").alias("demand_ratio"))


@dataclass
class Trees:
    """All trees as arrays: feature (-1: leaf), threshold, left, right, value; roots and weights."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    weights: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        # A leaf leads to itself, so that all rows take as many steps as the deepest tree has.
        inner, me = self.feature >= 0, np.arange(len(self.feature))
        feature = np.where(inner, self.feature, 0)
        after = np.stack([np.where(inner, self.right, me), np.where(inner, self.left, me)], axis=1)
        depth, reached = 0, self.roots
        while len(reached := reached[inner[reached]]):
            depth, reached = depth + 1, after[reached].ravel()
        after, flat, start = after.ravel(), np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
        out = np.zeros(len(x))
        for root, weight in zip(self.roots.tolist(), self.weights.tolist(), strict=True):
            node = np.full(len(x), root)
            for _ in range(depth):
                goes_left = flat.take(start + feature.take(node)) <= self.threshold.take(node)
                node = after.take(2 * node + goes_left)
            out += weight * self.value.take(node)
        return out


_SPLIT = re.compile(r"(If|Else) \(feature (\d+) (<=|>) ([^)]+)\)")


def parse_trees(text: str) -> Trees:
    """Trees from a fitted ensemble's description."""
    feature: list[int] = []
    threshold: list[float] = []
    left: list[int] = []
    right: list[int] = []
    value: list[float] = []
    roots: list[int] = []
    weights: list[float] = []
    lines = [line.strip() for line in text.split("\n")]
    at = 0

    def node() -> int:
        nonlocal at
        me = len(feature)
        for column, default in ((feature, -1), (threshold, 0.0), (left, -1), (right, -1), (value, 0.0)):
            column.append(default)
        m = _SPLIT.match(lines[at])
        if m:
            feature[me], threshold[me] = int(m[2]), float(m[4])
            at += 1
            left[me] = node()
            at += 1  # the Else line
            right[me] = node()
        else:
            value[me] = float(lines[at].removeprefix("Predict:"))
            at += 1
        return me

    while at < len(lines):
        m = re.match(r"Tree \d+ \(weight ([^)]+)\):", lines[at])
        at += 1
        if m:
            weights.append(float(m[1]))
            roots.append(node())
    return Trees(*(np.array(x) for x in (feature, threshold, left, right, value, roots, weights)))


def train(df: DataFrame, holdout: int, max_iter: int = 200, max_depth: int = 6, step_size: float = 0.05, min_instances: int = 20, seed: int = 42, least: int = 0) -> Trees | None:
    """Fit on all rows of all series of ``least`` rows; None where there are none."""
    rows = features(df, holdout, least).select(*FEATURES, F.col(Y))
    found = boost.fit(rows, max_iter, max_depth, step_size, min_instances, rate=0.8, share=0.8, seed=seed)
    return as_trees(found) if found else None


def as_trees(found: list[tuple[float, list]]) -> Trees:
    """Trees from the (weight, nodes) of each."""
    sizes = [len(nodes) for _, nodes in found]
    roots = np.cumsum([0, *sizes[:-1]])
    nodes = [(f, t, *(c + root if f >= 0 else -1 for c in (left, right)), v) for root, (_, own) in zip(roots.tolist(), found, strict=True) for f, t, left, right, v in own]
    feature, threshold, left, right, value = (np.array(x) for x in zip(*nodes, strict=True))
    return Trees(feature, threshold, left, right, value, roots, np.array([weight for weight, _ in found]))


def predict_batch(trees: Trees, histories: list[np.ndarray], weeks: np.ndarray, months: np.ndarray) -> np.ndarray:
    """Recursive forecasts of many series at once; weeks and months have a row per series."""
    s, h = weeks.shape
    stats = np.zeros((s, 4))
    tail = np.zeros((s, FIRST_ROW + h))  # the last 52 values, then the forecasts
    sizes = np.array([len(y) for y in histories])
    for r, y in enumerate(histories):
        if not len(y):
            continue
        nz = np.flatnonzero(y > 0)
        z = y[nz]
        cv = z.std() / z.mean() if len(z) > 1 and z.mean() > 0 else 0.0
        stats[r] = y.mean(), cv, (nz[-1] - nz[0]) / (len(nz) - 1) if len(nz) > 1 else float(len(y)), len(nz) / len(y)
        own = y[-FIRST_ROW:]
        tail[r, FIRST_ROW - len(own):FIRST_ROW] = own
    out = np.zeros((s, h))
    for t in range(h):
        now = FIRST_ROW + t
        x = np.zeros((s, len(FEATURES)))
        for c, k in enumerate(LAGS):
            x[:, c] = tail[:, now - k]  # zero before the series began
        for r_width, c in ((4, 5), (13, 6)):
            width = np.minimum(sizes + t, r_width)
            x[:, c] = tail[:, now - r_width:now].sum(axis=1) / np.maximum(width, 1)
        short = np.minimum(sizes + t, 4)
        mean = x[:, 5]
        x[:, 7] = np.sqrt(np.maximum((tail[:, now - 4:now] ** 2).sum(axis=1) / np.maximum(short, 1) - mean**2, 0.0))
        x[:, 8], x[:, 9], x[:, 10:] = weeks[:, t], months[:, t], stats
        tail[:, now] = out[:, t] = np.maximum(trees.predict(x), 0.0)
    return out


def with_forecast(series: DataFrame, trees: Trees | None, horizon: int, column: str, name: str, wanted: Column) -> DataFrame:
    """Add one model's forecasts to the rows of the series table where ``wanted`` holds, an empty array to others; NaN without a model."""
    one = "struct<model:string,model_ord:int,f:array<double>>"
    none = F.array().cast(f"array<{one}>")
    of = lambda f: F.array(F.struct(F.lit(name).alias("model"), F.lit(0).alias("model_ord"), f.alias("f"))).cast(f"array<{one}>")
    if trees is None:
        return series.withColumn(column, F.when(wanted, of(F.array_repeat(F.lit(float("nan")), horizon))).otherwise(none))
    ensure_importable()
    shared = series.sparkSession.sparkContext.broadcast(trees)  # size: trees x nodes, parameters
    dates = horizon_dates(F.col("last"), horizon)
    columns = [c for c in series.columns if c != column]
    fed = series.select(F.struct(*columns).alias("__row"), "y", F.transform(dates, iso_week).alias("w"), F.transform(dates, F.month).alias("mo"), F.coalesce(wanted, F.lit(False)).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = batch.filter(batch.column(4))
            at = np.flatnonzero(batch.column(4).to_numpy(zero_copy_only=False))
            found: list = [None] * batch.num_rows
            if len(at):
                ys, weeks, months = (chosen.column(i).to_pylist() for i in (1, 2, 3))
                for i, f in zip(at.tolist(), predict_batch(shared.value, [np.array(y, float) for y in ys], np.array(weeks), np.array(months)), strict=True):
                    found[i] = f
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], ["__row", "__f"])

    carried = fed.mapInArrow(run, StructType([fed.schema["__row"], StructField("__f", ArrayType(DoubleType()))]))
    return carried.select(*[F.col(f"__row.`{c}`").alias(c) for c in columns], F.when(F.col("__f").isNotNull(), of(F.col("__f"))).otherwise(none).alias(column))
