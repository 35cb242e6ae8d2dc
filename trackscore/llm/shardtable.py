"""Shard placement by a permutation-filled lookup table.

Every shard has its own preference order over the slots of a prime-sized table.
The shards take turns: each claims the first slot of its order that is still free,
until the table is full. A key hashes to a slot and the slot names the shard, so
placement takes constant time, shards own equal numbers of slots (one more or less),
and a change of the shard list moves few slots that the change does not concern.

The table is state of a fixed, small size (``slots`` integers). It is filled once and
broadcast; rows are placed by DataFrame functions only, without a shuffle of the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import packed

SLOTS = 2039  # prime, over a hundred slots for each of sixteen shards
MAX_SLOTS = 1_000_003  # what may be broadcast: a few MB
HEX_DIGITS = 15  # of SHA-256, so that the number fits a signed 64-bit integer


def number_of(text: str) -> int:
    return int(hashlib.sha256(text.encode()).hexdigest()[:HEX_DIGITS], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """Index of the owning shard for every slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct names, one at least")
    if not is_prime(slots) or len(shards) > slots or slots > MAX_SLOTS:
        raise ValueError(f"slots must be a prime from the number of shards to {MAX_SLOTS}")
    at = [number_of(f"offset:{name}") % slots for name in shards]
    step = [number_of(f"skip:{name}") % (slots - 1) + 1 if slots > 2 else 1 for name in shards]
    owner = [-1] * slots
    for turn in range(slots):
        shard = turn % len(shards)
        while owner[at[shard]] >= 0:
            at[shard] = (at[shard] + step[shard]) % slots
        owner[at[shard]] = shard
    return owner


def lookup_table(spark: SparkSession, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """(slot long, shard string), one row per slot."""
    owners = F.split(F.lit(",".join(map(str, fill(shards, slots)))), ",").cast("array<int>")
    names = F.lit(list(shards))
    return spark.range(1).select(F.posexplode(owners).alias("slot", "owner")).select(
        F.col("slot").cast("long").alias("slot"), F.element_at(names, F.col("owner") + 1).alias("shard"))


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key. A null key has the slot of the empty string."""
    digest = F.sha2(F.coalesce(key.cast("string"), F.lit("")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("long"), F.lit(slots))


def place(rows: DataFrame, key: str, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """``rows`` with columns ``slot`` and ``shard``; columns of those names are replaced.

    Every row is kept. Rows with equal keys share a shard, null and empty keys one slot;
    an empty table gives an empty result. A hot key loads one shard: place by a finer key
    (such as the document id) where rows of one key need not stay together.
    """
    table = lookup_table(rows.sparkSession, shards, slots)
    kept = rows.drop(*({"slot", "shard"} - {key}))
    at, owner = packed.unused(kept, "_slot"), packed.unused(kept, "_shard")
    slotted = kept.withColumn(at, slot_of(F.col(f"`{key}`"), slots))
    named = table.select(F.col("slot").alias(at), F.col("shard").alias(owner))
    joined = slotted.join(F.broadcast(named), at, "left")
    columns = [F.col(f"`{c}`") for c in kept.columns if c not in ("slot", "shard")]
    return joined.select(*columns, F.col(at).alias("slot"), F.col(owner).alias("shard"))


def moved_slots(spark: SparkSession, before: Sequence[str], after: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """Slots whose shard differs between two shard lists: (slot, old_shard, new_shard)."""
    old = lookup_table(spark, before, slots).withColumnRenamed("shard", "old_shard")
    new = lookup_table(spark, after, slots).withColumnRenamed("shard", "new_shard")
    return old.join(new, "slot").where("old_shard <> new_shard")
