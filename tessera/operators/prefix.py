"""Positions and prefix sums within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def positions(df: DataFrame, by: list[str], key: list[str], name: str, seed: int = 0,
              chunks: int | None = None) -> DataFrame:
    """Add ``name``: 0-based position of the row among the rows with its
    ``by`` values, ordered by a seeded hash of ``key`` (rows of equal key are
    neighbours, in any order).

    The hash cuts every group into ``chunks`` even parts (default: the number
    of shuffle partitions), so that a group with a third of all rows is
    numbered by many tasks.  The rows before a part come from a table with one
    row per group and part.  Parts depend on the row alone, so a task that runs
    again gives the same answer and nothing needs to be checkpointed.
    """
    spark = df.sparkSession
    n = chunks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    h = F.xxhash64(F.lit(seed), *[F.col(c) for c in key])
    part = F.pmod(F.shiftrightunsigned(h, 24), F.lit(n)).cast("int")
    rows = df.withColumns({"_h": h, "_part": part})
    counts = rows.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_part").alias("_by__part"),
                         F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    local = F.row_number().over(Window.partitionBy(*by, "_part").orderBy("_h", *key)) - 1
    on = F.col("_part") == F.col("_by__part")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    out = rows.withColumn("_local", local).join(base, on)
    return (out.withColumn(name, (F.col("_local") + F.col("_base")).cast("long"))
            .drop("_h", "_part", "_local", "_base", "_by__part", *[f"_by_{c}" for c in by]))


def prefix_sums(df: DataFrame, by: list[str], order: str, ties: list[str], values: dict, width: int = 12,
                group: DataFrame | None = None) -> DataFrame:
    """Add, for each ``name -> Column`` of ``values``, its sum over the rows
    before this one in its ``by`` group, in the order of the integer column
    ``order`` (nulls first) and ``ties``.

    A group is cut at fixed ranges of 2**``width`` order values.  Rows are
    summed within a range; the sums of the ranges before it come from a table
    with one row per range, 2**-width of the group where its order is dense.
    So a hot group is spread over as many tasks as it has ranges, and no
    measuring job or checkpoint is needed.

    ``group``: further columns of each group, one row for each ``by``; they
    come with the sums of the ranges, so the rows are not dealt again for them.
    """
    names = list(values)
    cut = F.shiftright(F.coalesce(F.col(order).cast("long"), F.lit(-(1 << 62))), width)
    # group and range in one value, in which nulls are equal: rows are dealt by it once, for the window and for the join
    rows = df.withColumns({f"_v_{n}": values[n] for n in names}).withColumn(
        "_g", F.struct(*[F.col(f"`{c}`").alias(f"b{i}") for i, c in enumerate(by)], cut.alias("c")))
    totals = rows.groupBy("_g").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in names])
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = Window.partitionBy(*[F.col(f"_g.b{i}") for i in range(len(by))]).orderBy("_g.c")
    base = totals.select(F.col("_g").alias("_bg"), *[before(f"_s_{n}", ranges).alias(f"_o_{n}") for n in names])
    if group is not None:
        base = base.join(group.withColumnsRenamed({c: f"_of_{c}" for c in by}),
                         [F.col(f"_bg.b{i}") == F.col(f"_of_{c}") for i, c in enumerate(by)], "left").drop(*[f"_of_{c}" for c in by])
    w = Window.partitionBy("_g").orderBy(F.col(order).asc_nulls_first(), *[F.col(t).asc_nulls_first() for t in ties])
    rows = rows.withColumns({f"_l_{n}": before(f"_v_{n}", w) for n in names})
    out = rows.join(base, F.col("_g") == F.col("_bg"))
    out = out.withColumns({n: (F.col(f"_l_{n}") + F.col(f"_o_{n}")).cast("long") for n in names})
    return out.drop("_g", "_bg", *[f"_{p}_{n}" for p in "vlo" for n in names])
