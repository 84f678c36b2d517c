"""Shards by a permutation-filled lookup table.

Each shard has a preference order over the slots of a prime-sized table (offset and step from md5 of
its name). Shards take turns: each claims its next preferred slot that is still free, until the table is
full. A key goes to the slot ``md5(key) mod size`` and so to the shard that owns it. Every shard owns
nearly equally many slots, and a shard that leaves moves few keys other than its own.

The table has a fixed size (a parameter), so it is the only thing that is broadcast; placement of a row
is one hash and one array lookup, without any shuffle.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, is_prime

#: Slots; a prime well over a hundred times the shards keeps their shares within about one percent.
SLOTS = 16381
SHARDS = 64


def preference(name: str, size: int) -> tuple[int, int]:
    """Offset and step of a shard's preference order; any step from 1 to size - 1 visits every slot of a prime size."""
    digest = hashlib.md5(name.encode()).hexdigest()
    return int(digest[:8], 16) % size, int(digest[8:16], 16) % (size - 1) + 1


def lookup_table(shards: list[str], size: int = SLOTS) -> list[int]:
    """Owner (index in shards) of each slot. Its work depends on size alone, never on the data."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be given and differ")
    if not is_prime(size) or size < len(shards):
        raise ValueError("the table's size must be a prime, and no less than the number of shards")
    at, step = zip(*(preference(s, size) for s in shards), strict=True)
    at, table, left = list(at), [-1] * size, size
    while left:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % size
            table[at[k]] = k
            left -= 1
            if not left:
                break
    return table


def slot_of(key: Column, size: int = SLOTS) -> Column:
    """Slot of a key's text form; a null key has the slot of the empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % size


def place(rows: DataFrame, key: str, shards: list[str], size: int = SLOTS) -> DataFrame:
    """rows with the added columns slot and shard (index). Existing columns with these names are replaced.

    Nulls and repeated keys: equal keys, nulls included, share a shard. Empty tables stay empty.
    """
    table = F.split(F.lit(",".join(map(str, lookup_table(shards, size)))), ",").cast("array<int>")
    return rows.withColumn("slot", slot_of(F.col(key), size)).withColumn("shard", F.element_at(table, (F.col("slot") + 1).cast("int")))


def write_shards(rows: DataFrame, key: str, shards: list[str], path: str, files_per_shard: int = 8) -> None:
    """Writes each shard to its own folder. A salt from the key spreads a shard over several files, so none waits for one task."""
    placed = place(rows, key, shards)
    salt = F.pmod(F.xxhash64(F.col(key)), F.lit(files_per_shard))
    placed.repartition(len(shards) * files_per_shard, "shard", salt).write.partitionBy("shard").parquet(path)


NAMES = [f"shard-{k:03d}" for k in range(SHARDS)]


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, slot, shard of every document."""
    return place(documents(spark, sf_dir).select("doc_id"), "doc_id", NAMES).select("doc_id", "slot", "shard")


def op9_sql() -> str:
    table = ",".join(map(str, lookup_table(NAMES)))
    slot = f"(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT % {SLOTS})"
    return f"WITH t AS (SELECT [{table}] AS owner) SELECT doc_id, {slot} AS slot, CAST(owner[{slot} + 1] AS INTEGER) AS shard FROM documents, t"
