"""Shared helpers: table access, scratch tables, and small column idioms."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

REPO = str(Path(__file__).resolve().parents[2])


def ensure_importable() -> None:
    """Pickle this package by value where the workers could not import it by name."""
    on_path = REPO in os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if not on_path and os.getcwd() != REPO:
        cloudpickle.register_pickle_by_value(sys.modules["weeklark"])


#: Size of an Arrow batch: texts may be long, and a batch is held on both sides.
ARROW_BYTES = "4m"
_ARROW_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python in batches of ARROW_BYTES, unless the session names a size of its own.

    The setting stays: tables that operators return are lazy, and their plans read it when they run.
    """
    if spark.sparkContext.getConf().get(_ARROW_KEY, None) is None:
        spark.conf.set(_ARROW_KEY, ARROW_BYTES)


def tidy() -> None:
    """Give freed memory back: a Python worker outlives its task and waits for the next one."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def kept_by(operator: str) -> dict:
    """What a Python worker keeps from task to task for one operator; what another one kept is given up."""
    kept = sys.modules.setdefault("_weeklark_kept", types.ModuleType("_weeklark_kept")).__dict__
    if kept.get("of") != operator:
        kept["of"], kept["what"] = operator, {}
        tidy()
    return kept["what"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; where that is unset, a local one, and only for a local master."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    set_before = spark.sparkContext.getCheckpointDir()
    if set_before:
        return set_before.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="weeklark-checkpoints-")
    spark.sparkContext.setCheckpointDir(local)
    return f"file://{local}"


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    try:
        _remove(spark, path)
    except Exception:  # noqa: BLE001 - the session may already have ended
        pass


class Scratch:
    """Tables written under the shared folder; they replace recomputation and survive lost executors.

    Those that a lazy result still reads stay until the driver exits, or
    until the end of a ``passing`` block.
    """

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark = spark
        self.path = f"{scratch_root(spark)}/weeklark-{name}-{uuid.uuid4().hex[:12]}"
        self.names: set[str] = set()
        self.tables: dict[str, str] = {}
        atexit.register(_remove_at_exit, spark, self.path)
        if _PASSING:
            _PASSING[-1].append(self)

    def write(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        where = f"{self.path}/{name}"
        self.names.add(name)
        df.write.mode("overwrite").option("compression", compression).parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def write_buckets(self, df: DataFrame, name: str, buckets: int, key: str) -> DataFrame:
        """Write in buckets by ``key``, each sorted by it, as a table of the session's catalogue: joins of such tables on the key shuffle neither."""
        self.tables[name] = f"weeklark_{uuid.uuid4().hex}"
        self.names.add(name)
        ordered = df.repartition(buckets, key).sortWithinPartitions(key)
        ordered.write.bucketBy(buckets, key).sortBy(key).option("path", f"{self.path}/{name}").option("compression", "zstd").format("parquet").saveAsTable(self.tables[name])
        return self.spark.table(self.tables[name])

    def drop(self, name: str) -> None:
        self.names.discard(name)
        if name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(name)}")
        _remove(self.spark, f"{self.path}/{name}")

    def drop_but(self, *kept: str) -> None:
        """Drop the tables whose names do not start with one of ``kept``."""
        for name in [n for n in self.names if not n.startswith(kept)]:
            self.drop(name)


_PASSING: list[list[Scratch]] = []


@contextlib.contextmanager
def passing() -> Iterator[None]:
    """Drop the scratch tables that operators make within the block at its end: for results that are written inside it."""
    _PASSING.append([])
    try:
        yield
    finally:
        for scratch in _PASSING.pop():
            _remove_at_exit(scratch.spark, scratch.path)


def wrapped(df: DataFrame, *needed: str) -> DataFrame:
    """The row as one struct, and the columns that an operator needs beside it: no other name can clash with the operator's own."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), *needed)


def unwrapped(df: DataFrame, columns: list[str], **replaced: Column) -> DataFrame:
    """The rows that ``wrapped`` took in, some columns replaced."""
    return df.select(*[(replaced[c] if c in replaced else F.col(f"__row.`{c}`")).alias(c) for c in columns])


def with_fields(schema: StructType, **kinds: DataType) -> StructType:
    """A schema and further nullable fields."""
    return StructType([StructField(f.name, f.dataType, True) for f in schema.fields] + [StructField(n, k, True) for n, k in kinds.items()])


#: A table of a few numbers a row is broadcast up to this many rows, and joined by shuffling beyond.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast ``df`` if its known number of rows allows."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a bound variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def steps(n: Column) -> Column:
    """Array 0 .. n-1; empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def running_sums(values: Column, block: int = 256) -> Column:
    """Inclusive running sums of an array<bigint>, in blocks so that the cost stays near linear."""
    zero = F.array().cast("array<bigint>")

    def last(xs: Column, otherwise: Column) -> Column:
        return F.when(F.size(xs) > 0, F.element_at(xs, -1)).otherwise(otherwise)

    def whole(xs: Column) -> Column:
        blocks = F.transform(steps(F.ceil(F.size(xs) / F.lit(block))), lambda k: F.slice(xs, k * block + 1, F.lit(block)))

        def join(acc: Column, xs_: Column) -> Column:
            return F.concat(
                acc,
                F.aggregate(
                    xs_, F.array(F.lit(0).cast("bigint") + last(acc, F.lit(0).cast("bigint"))),
                    lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)), lambda a: F.slice(a, 2, F.size(a)),
                ),
            )

        return let(blocks, lambda bs: F.aggregate(bs, zero, join))

    return let(values, whole)
