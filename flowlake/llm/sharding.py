"""Sharding by a permutation-filled lookup table (native).

Each shard has its own preference order over the slots of a prime-sized table (a start and a step
taken from a hash of its name). Shards take turns; at each turn a shard claims the first slot of
its order that is free, until the table is full. Every shard gets nearly the same number of slots,
and when a shard comes or goes most slots keep their owner. The table is a constant of the shard
list (``SLOTS`` entries whatever the data), so it is broadcast; a document's key hashes to a slot
and the slot names the shard. No row is shuffled.

A document without an id is placed by its text, so that such rows don't meet in one shard; repeated
rows share a shard. Other columns pass through; columns named ``slot`` or ``shard`` are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = tuple(f"shard-{i:03d}" for i in range(64))
SLOTS = 6553  # prime, about a hundred slots for each shard


def digest(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16)


def fill(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> list[int]:
    """The owner of every slot, as an index into ``shards``."""
    if not shards or slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("sharding needs a shard at least and a prime number of slots")
    start = [digest(f"start:{s}") % slots for s in shards]
    step = [digest(f"step:{s}") % (slots - 1) + 1 for s in shards]
    owner, tried, free = [-1] * slots, [0] * len(shards), slots
    while free:
        for i in range(len(shards)):
            if not free:
                break
            slot = (start[i] + tried[i] * step[i]) % slots
            while owner[slot] >= 0:
                tried[i] += 1
                slot = (start[i] + tried[i] * step[i]) % slots
            owner[slot] = i
            tried[i] += 1
            free -= 1
    return owner


def lookup_table(spark: SparkSession, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """slot, shard: one row for each slot."""
    owners = F.split(F.lit(",".join(map(str, fill(shards, slots)))), ",")
    names = F.split(F.lit("\x00".join(shards)), "\x00")
    one = spark.range(1).select(F.posexplode(owners).alias("slot", "at"))
    return one.select(F.col("slot").cast("long"), F.get(names, F.col("at").cast("int")).alias("shard"))


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") % slots


def shard(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Every row with its ``slot`` and ``shard``."""
    name = F.coalesce(F.col(key).cast("string"), F.md5(F.coalesce(F.col(text), F.lit(""))))
    rows = docs.drop("slot", "shard").withColumn("slot", slot_of(name, slots))
    return rows.join(F.broadcast(lookup_table(docs.sparkSession, shards, slots)), "slot")


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", files_per_shard: int = 8, **options) -> None:
    """One folder for each shard, each in several files so that no task writes a whole shard.

    A row's file comes from a hash of its key and text, so that a task that runs again after a lost
    executor deals its rows as before.
    """
    rows = shard(docs, key, text, **options).withColumn("__file", F.pmod(F.xxhash64(key, text), F.lit(files_per_shard)))
    rows.repartition("shard", "__file").drop("__file").write.partitionBy("shard").parquet(path)
