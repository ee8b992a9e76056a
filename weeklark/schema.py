"""Internal column names, output schemas, and how caller's names map to them."""

from __future__ import annotations

import os
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ID, DATE, Y, GRP = "__id", "__date", "__y", "__grp"

METHODS = ("direct", "aggregate_fallback", "global_avg_fallback")
CATEGORIES = ("smooth", "erratic", "intermittent", "lumpy")

GROUP_SEPARATOR = "||"


REPO = str(Path(__file__).resolve().parents[1])


def ensure_importable() -> None:
    """Pickle this package by value where the Python workers could not import it by name."""
    on_path = REPO in os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if not on_path and os.getcwd() != REPO:
        cloudpickle.register_pickle_by_value(sys.modules[__name__.split(".")[0]])


def group_key(columns: Sequence[str]) -> Column:
    """Composite key of several columns; a null reads as the text None."""
    return F.concat_ws(GROUP_SEPARATOR, *[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in columns])


def normalise(df: DataFrame, date_col: str, id_col: str, value_col: str, group: Column | None = None) -> DataFrame:
    """(id, date, y[, grp]) with internal names; rows of null id go, as in a group-by that ignores null keys."""
    columns = [F.col(id_col).alias(ID), F.col(date_col).cast("date").alias(DATE), F.col(value_col).cast("double").alias(Y)]
    if group is not None:
        columns.append(group.alias(GRP))
    return df.select(*columns).filter(F.col(ID).isNotNull())
