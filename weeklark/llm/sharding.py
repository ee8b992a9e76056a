"""Sharding by a permutation-filled lookup table (consistent placement) [native].

Each shard derives a permutation of the slots of a prime-sized table from
two digests of its name. The shards take turns; on its turn a shard claims
the first slot of its permutation that is still free, until no slot is
left. Shares differ by at most one slot, and when a shard leaves or joins,
few slots change hands. The table has a fixed size, so broadcasting it is
bounded, and placing a row is one digest and one lookup.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prime; 64 shards get 255 or 256 slots each.
TABLE_SIZE = 16_381
N_SHARDS = 64
#: Hex digits of the key's digest that choose the slot (60 bits).
DIGEST_DIGITS = 15


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """Slot -> index of the shard that owns it."""
    names = list(shards)
    if not names or len(set(names)) != len(names):
        raise ValueError("shards must be distinct and not empty")
    if not _is_prime(size) or size < len(names):
        raise ValueError("the table's size must be prime and at least the number of shards")
    place, step = [], []
    for name in names:
        digest = hashlib.md5(name.encode()).digest()
        place.append(int.from_bytes(digest[:8], "big") % size)
        step.append(int.from_bytes(digest[8:], "big") % (size - 1) + 1)
    owner = [-1] * size
    left = size
    while left:
        for shard in range(len(names)):
            while owner[place[shard]] >= 0:
                place[shard] = (place[shard] + step[shard]) % size
            owner[place[shard]] = shard
            left -= 1
            if not left:
                break
    return owner


def table_frame(spark: SparkSession, owners: Sequence[int]) -> DataFrame:
    """(slot, shard) rows; the number of rows is the fixed table size."""
    return spark.range(1).select(
        F.posexplode(F.split(F.lit(",".join(map(str, owners))), ",")).alias("slot", "owner")
    ).select(F.col("slot").cast("bigint").alias("slot"), F.col("owner").cast("int").alias("shard"))


def slot_of(key: Column, size: int) -> Column:
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("\x00null")).cast("binary")), 1, DIGEST_DIGITS)
    return F.pmod(F.conv(digits, 16, 10).cast("bigint"), F.lit(size).cast("bigint"))


def shard(
    df: DataFrame, key: str, shards: Sequence[str] | int = N_SHARDS, size: int = TABLE_SIZE,
    spread_by: str | None = None, spread: int = 1,
) -> DataFrame:
    """Add ``slot`` and ``shard`` to every row.

    A null key has one fixed slot; an empty text is a key like others, and a
    key of any length is one digest; equal keys share a slot, so repeated
    rows stay together; an empty table gives an empty table. Columns of
    ``df`` that are called slot or shard are replaced, even where one of
    them is the key. A key that holds a large part of all rows can be dealt to
    ``spread`` slots by a second column.
    """
    names = [f"shard-{i:05d}" for i in range(shards)] if isinstance(shards, int) else list(shards)
    by = F.col(f"`{key}`").cast("string")
    if spread_by and spread > 1:
        by = F.concat_ws("\x01", by, F.pmod(F.hash(F.col(spread_by)), F.lit(spread)).cast("string"))
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("slot", "shard")], slot_of(by, size).alias("slot"))
    return kept.join(F.broadcast(table_frame(df.sparkSession, lookup_table(names, size))), "slot", "left")


def write_shards(df: DataFrame, path: str, key: str, shards: Sequence[str] | int = N_SHARDS) -> None:
    """One folder per shard; each task appends to the shards of its own rows, so nothing is shuffled."""
    shard(df, key, shards).drop("slot").write.partitionBy("shard").parquet(path)
