"""Sharding by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a table of prime size: an offset and a
step from a hash of its name. The shards take turns, each claiming the first slot in its order that
is free, until the table is full. Shares then differ by one slot at most, and a shard that comes or
goes moves few keys besides its own. The table is a constant array in the plan, of a size that
depends on the parameters and not on the data; a key is placed by one hash and one array access, with
no shuffle.

Cases: a null key is placed as the empty string. Equal keys, repeated rows among them, share a
shard. Keys of any length are hashed whole. An empty table gives an empty result. `place` adds its
two columns and replaces columns that have their names already.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import digest_int, named

SHARDS = tuple(f"shard-{i:03d}" for i in range(64))
SLOTS = 65_537


def _hash(name: str, use: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{use}:{name}".encode()).digest()[:8], "big")


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> list[int]:
    """The index of the shard that owns each slot."""
    if len(set(shards)) != len(shards) or not shards:
        raise ValueError("shards must have distinct names, and there must be one at least")
    if not is_prime(slots) or slots < len(shards):
        raise ValueError(f"{slots} slots: needs a prime number that isn't less than the number of shards")
    step = [_hash(s, "step") % (slots - 1) + 1 for s in shards]
    wish = [_hash(s, "offset") % slots for s in shards]
    owner = [-1] * slots
    filled = 0
    while True:
        for i in range(len(shards)):
            while owner[wish[i]] >= 0:
                wish[i] = (wish[i] + step[i]) % slots
            owner[wish[i]] = i
            filled += 1
            if filled == slots:
                return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(digest_int(F.coalesce(key.cast("string"), F.lit(""))), F.lit(slots)).cast("int")


def place(df: DataFrame, key_col: str = "doc_id", shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """df with the columns slot and shard (the index of the shard)."""
    owners = F.split(F.lit(",".join(map(str, lookup_table(shards, slots)))), ",").cast("array<int>")  # folded to a constant
    placed = df.withColumn("slot", slot_of(named(key_col), slots))
    return placed.withColumn("shard", F.element_at(owners, F.col("slot") + 1))


def write_shards(df: DataFrame, path: str, key_col: str = "doc_id", shards: tuple[str, ...] = SHARDS, slots: int = SLOTS, tasks: int = 16) -> None:
    """Write df with one folder for each shard, each by several tasks; rows of one key are spread over them too."""
    placed = place(df, key_col, shards, slots).drop("slot")
    rest = [named(f.name) for f in df.schema.fields if f.name != "shard" and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    part = F.pmod(F.xxhash64(*rest), F.lit(tasks)).cast("int")
    placed.repartitionById(len(shards) * tasks, F.col("shard") * tasks + part).write.partitionBy("shard").parquet(path)


def oracle(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> str:
    owners = ",".join(map(str, lookup_table(shards, slots)))
    return f"""
WITH owners AS (SELECT [{owners}] AS o),
     slots AS (SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT % {slots} AS INTEGER) AS slot FROM documents)
SELECT doc_id, slot, CAST(o[slot + 1] AS INTEGER) AS shard FROM slots, owners"""
