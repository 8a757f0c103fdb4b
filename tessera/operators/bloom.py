"""Rows without a partner, behind a Bloom filter.

"Which references have no file", "which prompts are not in the cache": an anti
join that shuffles every row to find that most have no partner.  Here the keys
that exist are first made into a filter - sized by their number, at
``BITS`` bits each, in chunks of 4 KB, all bits of a key in one chunk -
and a row whose key the filter does not have is known to be without a partner
where it stands.  Only the others are joined.

The filter is a small table (1.25 bytes a key), broadcast as long as it has at
most ``MAX_BYTES``; beyond that, or without keys, all rows are joined.  The
answer is the same in every case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

BITS, HASHES, CHUNK_BITS = 10, 5, 1 << 15
MAX_BYTES = 64 << 20


def _chunk(key: Column, chunks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(chunks)).cast("int")


def _bits(key: Column) -> list[Column]:
    """Places of the key's bits in its chunk, from two further hashes."""
    a, b = (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(CHUNK_BITS)) for seed in (1, 2))
    return [F.pmod(a + b * i, F.lit(CHUNK_BITS)).cast("int") for i in range(HASHES)]


def bloom_filter(keys: DataFrame, key: Column, count: int) -> tuple[DataFrame, int]:
    """(saved table _chunk, _bitmap; number of chunks) of the values of ``key``."""
    chunks = max(1, -(-count * BITS // CHUNK_BITS))
    bits = keys.select(_chunk(key, chunks).alias("_chunk"), F.explode(F.array(*_bits(key))).alias("_bit"))
    path = scratch_path(keys.sparkSession, "bloom")
    bits.groupBy("_chunk").agg(F.bitmap_construct_agg("_bit").alias("_bitmap")).write.parquet(path)
    return keys.sparkSession.read.schema("_chunk int, _bitmap binary").parquet(path), chunks


def _set(bitmap: Column, bit: Column) -> Column:
    """Whether a bit of a bitmap is set (the lowest bit of a byte comes first)."""
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, bit % 8) != 0


def without_partner(df: DataFrame, keys: DataFrame, left: str, right: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The rows of ``df`` whose ``left`` is not among the values of
    ``keys.right`` (a null has no partner)."""
    found = keys.select(F.col(right).alias("_key")).filter("_key IS NOT NULL")
    plain = lambda x: x.join(found, x[left] == F.col("_key"), "left_anti")
    count = found.count()
    if not count or count * BITS // 8 > max_bytes:
        return plain(df)
    table, chunks = bloom_filter(found, F.col("_key"), count)
    key = F.col(left)
    seen = df.withColumn("_at", _chunk(key, chunks)).join(F.broadcast(table), F.col("_at") == F.col("_chunk"), "left")
    hit = F.col("_bitmap").isNotNull() & key.isNotNull()
    for bit in _bits(key):
        hit = hit & F.coalesce(_set(F.col("_bitmap"), bit), F.lit(False))
    maybe = seen.withColumn("_maybe", hit)
    absent = maybe.filter(~F.col("_maybe")).select(*[F.col(f"`{c}`") for c in df.columns])
    rest = maybe.filter("_maybe").select(*[F.col(f"`{c}`") for c in df.columns])
    return absent.unionByName(plain(rest))
