"""Run models over the series table: native ones as expressions, Python ones in Arrow batches that carry the rest of the row along."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from ..functions import models as models_
from ..functions.columns import nan, settled
from ..functions.registry import Model, model, order_of
from ..schema import ID, ensure_importable

FORECASTS = "__forecasts"
_ONE = "struct<model:string,model_ord:int,f:array<double>>"


def _struct(m: Model, horizon: int) -> Column:
    return F.struct(F.lit(m.name).alias("model"), F.lit(order_of(m.name)).alias("model_ord"), m.native(horizon).alias("f"))


_FOUND = ArrayType(StructType([StructField("model", StringType()), StructField("model_ord", IntegerType()), StructField("f", ArrayType(DoubleType()))]))
_FOUND_ARROW = pa.list_(pa.struct([("model", pa.string()), ("model_ord", pa.int32()), ("f", pa.list_(pa.float64()))]))


def _values(m: Model, ys: list[np.ndarray], dates: list[np.ndarray], horizon: int) -> np.ndarray:
    """A row of forecasts for each series; a model that fails for a series is out of the contest there."""
    if m.batch:
        return np.asarray(m.batch(ys, dates, horizon=horizon), float)
    out = np.full((len(ys), horizon), np.nan)
    for row, y, when in zip(out, ys, dates, strict=True):
        try:
            f = np.asarray(m.python(y, when, horizon=horizon), float)
            if f.shape != (horizon,):
                raise ValueError("a model returns one value per step")
            row[:] = f
        except Exception:  # noqa: BLE001 - NaN, as the contract says
            pass
    return out


def _python(models: Sequence[Model], orders: dict[str, int], horizon: int):
    """Rows (row, y, dates, wanted) to (row, found); a null ``wanted`` asks for all models."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ys = [np.array(y, float) for y in batch.column(1).to_pylist()]
            dates = [np.array(d, "datetime64[ns]") for d in batch.column(2).to_pylist()]
            asked = [None if w is None else set(w) for w in batch.column(3).to_pylist()]
            found: list[list[dict]] = [[] for _ in ys]
            for m in models:
                at = [i for i, w in enumerate(asked) if w is None or m.name in w]
                if at:
                    for i, f in zip(at, _values(m, [ys[i] for i in at], [dates[i] for i in at], horizon), strict=True):
                        found[i].append({"model": m.name, "model_ord": orders[m.name], "f": f})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _FOUND_ARROW)], ["__row", "__more"])

    return run


def with_forecasts(series: DataFrame, names: Sequence[str], horizon: int, wanted: str | None = None) -> DataFrame:
    """Add ``__forecasts``: array<struct<model, model_ord, f>> over the models of ``names``, by model_ord.

    With ``wanted``, a column that holds a model's name or an array of
    names, only those are computed for a row: a branch that is not taken is
    not evaluated, and Python models look at it before they run. They get
    the dates of the training rows as they are in the series.
    """
    models = [model(n) for n in names]
    native, python = [m for m in models if m.native], [m for m in models if m.python]

    def asked(m: Model) -> Column:
        column = F.col(wanted)
        return F.array_contains(column, m.name) if series.schema[wanted].dataType.typeName() == "array" else column == m.name

    columns = series.columns
    series = settled(series.withColumn(models_.WEEKS, models_.horizon_weeks(horizon)))
    own = [F.when(asked(m), _struct(m, horizon)) if wanted else _struct(m, horizon) for m in native]
    found = F.array(*own) if own else F.array().cast(f"array<{_ONE}>")
    out = series.withColumn(FORECASTS, F.filter(found, lambda x: x.isNotNull()) if wanted else found).select(*columns, FORECASTS)
    if python:
        ensure_importable()
        keep = out.columns
        asked = F.lit(None).cast("array<string>") if not wanted else F.col(wanted) if series.schema[wanted].dataType.typeName() == "array" else F.array(wanted)
        fed = out.select(F.struct(*keep).alias("__row"), "y", "train_dates", asked.alias("__asked"))
        schema = StructType([fed.schema["__row"], StructField("__more", _FOUND)])
        carried = fed.mapInArrow(_python(python, {m.name: order_of(m.name) for m in python}, horizon), schema)
        both = F.array_sort(F.concat(F.col(f"__row.{FORECASTS}"), F.col("__more")), _by_order)
        return carried.select(*[both.alias(c) if c == FORECASTS else F.col(f"__row.`{c}`").alias(c) for c in keep])
    return out.withColumn(FORECASTS, F.array_sort(FORECASTS, _by_order))


def _by_order(a: Column, b: Column) -> Column:
    return (a["model_ord"] - b["model_ord"]).cast("int")


def wape_of(actual: Column, forecast: Column) -> Column:
    """Absolute error over absolute demand; infinite for no demand, NaN for a NaN forecast."""
    error = F.aggregate(F.zip_with(actual, forecast, lambda a, f: F.abs(a - f)), F.lit(0.0), lambda s, x: s + x)
    size = F.aggregate(actual, F.lit(0.0), lambda s, x: s + F.abs(x))
    return F.when(size == 0, F.lit(float("inf"))).otherwise(error / F.nullif(size, F.lit(0.0)))


def naive_error(y: Column, period: int = 52) -> Column:
    """Mean absolute difference from a year before; null where there is none, or it is zero."""
    n = F.size(y)
    diffs = F.zip_with(F.slice(y, period + 1, F.greatest(n - period, F.lit(0))), F.slice(y, F.lit(1), F.greatest(n - period, F.lit(0))), lambda a, b: F.abs(a - b))
    return F.when(n > period, F.nullif(F.aggregate(diffs, F.lit(0.0), lambda s, x: s + x) / F.greatest(n - period, F.lit(1)), F.lit(0.0)))


def mase_of(actual: Column, forecast: Column, naive: Column) -> Column:
    error = F.aggregate(F.zip_with(actual, forecast, lambda a, f: F.abs(a - f)), F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(actual), F.lit(0))
    return F.when(naive.isNull(), F.lit(float("inf"))).otherwise(F.coalesce(error / naive, nan()))
