"""Thresholds against a sort."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import rows as R
from tessera.operators import score as S
from tessera.operators import select as SEL


def ties(n, seed):
    rnd = random.Random(seed)
    value = lambda: rnd.choice([0.5, 0.5, 0.25, None, float("nan"), rnd.random(), -rnd.random(), 1e300, -1e300])
    return [(i, value(), rnd.choice(["", "a", "ab", "é", "aé", None, "x" * 13 + str(rnd.randrange(30))])) for i in range(n)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ties(3000, 1), "id long, s double, t string").repartition(5).cache()


@pytest.mark.parametrize("ratio,few", [(0.0, 10_000), (0.1, 3), (0.8, 3), (0.8, 10_000), (0.9999, 30), (1.0, 10_000)])
def test_split_equals_the_ranked_split(spark, table, monkeypatch, ratio, few):
    monkeypatch.setattr(SEL, "FEW", few)
    order = S.rank_order("s", "id")
    got = {r.id: r.split for r in SEL.split_by_threshold(table, order, ratio).collect()}
    want = {r.id: r.split for r in R.ratio_split(table, order, ratio).collect()}
    assert got == want


def test_every_kind_of_key(spark, table, monkeypatch):
    monkeypatch.setattr(SEL, "FEW", 20)
    rows = table.collect()
    for column, how in (("t", "asc_nulls_first"), ("t", "desc_nulls_last"), ("id", "desc")):
        sign = how.startswith("desc")
        some = sorted((r for r in rows if r[column] is not None),
                      key=lambda r: (r[column].encode() if column == "t" else r[column]), reverse=sign)
        null = [r for r in rows if r[column] is None]
        order = sorted(null, key=lambda r: r.id) + some if how.endswith("first") else some + null
        # within ties by id
        key = {}
        for r in order:
            key.setdefault(r[column], len(key))
        order.sort(key=lambda r: (key[r[column]], r.id))
        for n in (1, 2222):
            got = table.filter(SEL.first_rows(table, [(F.col(column), how), "id"], n)).select("id").collect()
            assert sorted(r.id for r in got) == sorted(r.id for r in order[:n]), (column, how, n)


def test_one_value_in_almost_all_rows(spark, monkeypatch):
    monkeypatch.setattr(SEL, "FEW", 50)
    df = spark.range(20_000).select("id", F.when(F.col("id") % 100 == 0, F.col("id").cast("double")).otherwise(7.0).alias("s"))
    got = df.filter(SEL.first_rows(df, [(F.col("s"), "asc"), "id"], 10_000))
    want = df.orderBy("s", "id").limit(10_000)
    assert got.count() == 10_000 and got.exceptAll(want).count() == 0


@pytest.mark.parametrize("rate", [0.0, 0.25, 1.5])
def test_sample_equals_the_ranked_sample(spark, rate):
    df = spark.range(1234).withColumn("x", F.col("id") * 2)
    got = sorted(r.id for r in SEL.sample_by_threshold(df, "id", rate, seed=3).collect())
    assert got == sorted(r.id for r in R.sample_exact(df, "id", rate, seed=3).collect())
    assert len(got) == min(1234, math.floor(1234 * rate))
    assert SEL.sample_by_threshold(df.limit(0), "id", 0.5).count() == 0


def test_no_row_is_moved(spark):
    plan = SEL.split_by_threshold(spark.range(100).withColumn("s", F.col("id") % 7 / 2), S.rank_order("s", "id"), 0.8)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
