"""Shard placement by a permutation-filled lookup table.

Every shard has a permutation of the slots of a table whose size is prime
(offset and skip from two hashes of its name). Shards take turns: each claims
the first free slot of its own permutation, until all slots are claimed. A
key's slot is its hash modulo the table size, so a lookup takes constant time,
the shards' shares differ by one slot at most, and a change of the shard list
moves little more than the keys of the shards that changed.

The table has ``table_size`` rows whatever the data, which is why it may be
broadcast. Keys are placed row by row: nothing is grouped by key, so a hot key
or source makes no hot task.

Defined results: a null key is placed as the empty string; equal keys go to
the same shard; an empty table gives no rows; an empty shard list, a repeated
shard or a size that is not a prime of at least the number of shards raises
ValueError.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime; over 100 slots per shard for 40 shards, so shares differ by less than 1 %.
TABLE_SIZE = 4099


def _is_prime(n: int) -> bool:
    return n >= 2 and all(n % k for k in range(2, int(n ** 0.5) + 1))


def fill_table(shards: list[str], table_size: int = TABLE_SIZE) -> list[str]:
    """The shard of each slot."""
    if not shards or len(set(shards)) < len(shards) or not _is_prime(table_size) or table_size < len(shards):
        raise ValueError("shards must be distinct and the table size a prime that is not below their number")

    def number(kind: str, shard: str) -> int:
        return int.from_bytes(hashlib.md5(f"{kind}:{shard}".encode()).digest()[:8], "big")

    offset = [number("offset", s) % table_size for s in shards]
    skip = [number("skip", s) % (table_size - 1) + 1 if table_size > 2 else 1 for s in shards]
    step, table, free = [0] * len(shards), [None] * table_size, table_size
    while True:
        for i, shard in enumerate(shards):
            while table[slot := (offset[i] + step[i] * skip[i]) % table_size] is not None:
                step[i] += 1
            table[slot] = shard
            step[i] += 1
            free -= 1
            if not free:
                return table


def lookup_table(spark: SparkSession, shards: list[str], table_size: int = TABLE_SIZE) -> DataFrame:
    return spark.createDataFrame(list(enumerate(fill_table(shards, table_size))), "slot int, shard string")


def slot_of(key: Column, table_size: int = TABLE_SIZE) -> Column:
    """The first 32 bits of the key's MD5, modulo the table size."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") % table_size).cast("int")


def place(rows: DataFrame, key: str, shards: list[str], table_size: int = TABLE_SIZE) -> DataFrame:
    """The key column with its slot and shard (named ``slot`` and ``shard``), by a broadcast of the bounded table.

    A key column of one of these two names is returned as ``key``.
    """
    keyed = rows.select(F.col(key).alias("key")).withColumn("slot", slot_of(F.col("key"), table_size))
    placed = keyed.join(F.broadcast(lookup_table(rows.sparkSession, shards, table_size)), "slot")
    return placed.select(F.col("key").alias("key" if key in ("slot", "shard") else key), "slot", "shard")


def write_shards(rows: DataFrame, path: str, key: str, shards: list[str], table_size: int = TABLE_SIZE) -> None:
    """Write all columns of the rows as Parquet, one folder per shard, without a shuffle.

    The folder column is called ``shard``; an input column of that name is an error.
    """
    table = lookup_table(rows.sparkSession, shards, table_size).withColumnRenamed("slot", "__slot")
    placed = rows.withColumn("__slot", slot_of(F.col(key), table_size)).join(F.broadcast(table), "__slot")
    placed.drop("__slot").write.partitionBy("shard").parquet(path)
