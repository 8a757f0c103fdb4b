"""The filtered anti join against the plain one."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import bloom


@pytest.mark.parametrize("kind", ["string", "bigint"])
@pytest.mark.parametrize("most", [bloom.MAX_BYTES, 0])
def test_same_rows_as_the_plain_join(spark, kind, most):
    keys = spark.range(0, 40_000, 2).select(F.col("id").cast(kind).alias("k")).union(spark.sql(f"SELECT CAST(NULL AS {kind})"))
    df = spark.range(0, 60_000).select(F.when(F.col("id") % 500 != 7, F.col("id")).cast(kind).alias("x"), (F.col("id") % 3).alias("_other"))
    df = df.unionByName(df.limit(50))
    got = bloom.without_partner(df, keys, "x", "k", max_bytes=most)
    want = df.join(keys, df.x == keys.k, "left_anti")
    assert got.columns == df.columns and got.count() == want.count()
    assert got.exceptAll(want).count() == 0 and got.filter("x IS NULL").count() > 100
    none = bloom.without_partner(df, keys.limit(0), "x", "k")
    assert none.count() == df.count()


def test_filter_knows_every_key_and_few_others(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("media/"), F.col("id").cast("string")).alias("k"))
    table, chunks = bloom.bloom_filter(keys, F.col("k"), 20_000)
    assert table.count() == chunks == -(-20_000 * bloom.BITS // bloom.CHUNK_BITS)

    def passed(df):
        x = df.withColumn("_at", bloom._chunk(F.col("k"), chunks)).join(table, F.col("_at") == F.col("_chunk"))
        ok = F.lit(True)
        for bit in bloom._bits(F.col("k")):
            ok = ok & bloom._set(F.col("_bitmap"), bit)
        return x.filter(ok).count()
    assert passed(keys) == 20_000
    assert passed(spark.range(20_000, 40_000).select(F.concat(F.lit("media/"), F.col("id").cast("string")).alias("k"))) < 1000
