"""Row selection over a total order: positions, head, ranges, splits,
exact samples, seeded shuffles, batch numbers and next-row fallbacks.

No operator here ranks rows through an unpartitioned window: that plans
``Exchange SinglePartition`` and sends every row through one task.  A
position is computed instead as

1. take the order columns alone, range-partition on them (bounds are
   sampled, so one hot value of a leading key still spreads over many
   partitions because the tie-break keys follow it), sort inside each
   partition, number rows locally;
2. write that narrow numbered table to the reliable checkpoint folder, so
   the numbering is stable when an executor is lost and tasks rerun;
3. count rows per partition and turn the counts into offsets with a window
   over that small table, added back with a broadcast join (one row per
   partition);
4. join the positions back to the rows on the unique last order column.

Positions and sums within groups are prefix sums over ranges of the order
(``prefix.prefix_sums``): one plan for groups of every size.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .prefix import prefix_sums

_PID, _LOCAL, _ADJ = "_t_pid", "_t_local", "_t_adj"


def with_positions(df: DataFrame, order_by: Sequence, name: str = "pos") -> DataFrame:
    """Add ``name`` = 0-based position of each row in ``order_by``, a total
    order that ends with the name of a unique, non-null key."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    key = order_by[-1]
    names = [f"_o{i}" for i in range(len(order_by) - 1)]
    narrow = df.select(key, *[_order_value(c).alias(n) for c, n in zip(order_by, names)])
    keys = [_like(c, F.col(n)) for c, n in zip(order_by, names)] + [F.col(key)]
    numbered = (narrow.repartitionByRange(*keys).sortWithinPartitions(*keys)
                .select(key, F.spark_partition_id().alias(_PID), F.monotonically_increasing_id().alias(_LOCAL))
                .withColumn(_LOCAL, F.col(_LOCAL) - F.shiftleft(F.col(_PID).cast("bigint"), 33))
                .checkpoint(eager=True))
    counts = numbered.groupBy(_PID).agg(F.count(F.lit(1)).alias("_n"), F.min(_LOCAL).alias("_first"))
    before = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition: the size bound is the partition count
    offsets = F.broadcast(counts.select(_PID, (F.coalesce(F.sum("_n").over(before), F.lit(0))
                                               - F.col("_first")).alias(_ADJ)))
    place = numbered.join(offsets, _PID).select(key, (F.col(_LOCAL) + F.col(_ADJ)).cast("bigint").alias(name))
    return df.join(place, key)


def _order_value(c) -> Column:
    """The expression an order entry sorts by (a name, a column, or a column
    with a direction)."""
    return F.col(c) if isinstance(c, str) else c[0]


def _like(c, value: Column) -> Column:
    """``value`` sorted in the direction of the order entry."""
    return value if isinstance(c, str) else getattr(value, c[1])()


def row_count(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    by = list(by)
    if by:
        return df.groupBy(*by).agg(F.count(F.lit(1)).alias("_cnt"))
    return df.agg(F.count(F.lit(1)).alias("_cnt"))


def head_n(df: DataFrame, n: int, order_by: Sequence) -> DataFrame:
    """``df.head(n)`` in a stated order: TakeOrderedAndProject (top-k)."""
    return df.orderBy(*[_like(c, _order_value(c)) for c in order_by]).limit(n)


def row_range(df: DataFrame, start: int, end: int, order_by: Sequence, name: str = "pos") -> DataFrame:
    """``iloc[start:end]``: half-open position range."""
    return with_positions(df, order_by, name=name).filter((F.col(name) >= start) & (F.col(name) < end))


def ratio_split(df: DataFrame, order_by: Sequence, ratio: float = 0.8, name: str = "split",
                pos: str = "pos") -> DataFrame:
    """First ``int(n * ratio)`` rows in order are train, the rest test."""
    ranked = with_positions(df, order_by, name=pos)
    # scalar subquery: partial counts per partition, one value broadcast back
    n = ranked.agg(F.count(F.lit(1))).scalar()
    cut = F.floor(n * F.lit(float(ratio)).cast("double"))
    return ranked.withColumn(name, F.when(F.col(pos) < cut, F.lit("train")).otherwise(F.lit("test")))


def seeded_key(id_col, seed: int = 0) -> Column:
    """Deterministic pseudo-random order key: md5 of seed and id."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))


def shuffle_seeded(df: DataFrame, id_col: str, seed: int = 0, name: str = "pos") -> DataFrame:
    """``random.shuffle`` made reproducible: position in md5(seed, id) order."""
    return with_positions(df.withColumn("_shuf", seeded_key(id_col, seed)),
                          ["_shuf", id_col], name=name).drop("_shuf")


def sample_exact(df: DataFrame, id_col: str, rate, by: Sequence[str] = (), seed: int = 0,
                 name: str = "pos") -> DataFrame:
    """``random.sample(rows, int(len(rows) * rate))`` per ``by`` group.

    ``rate`` is a float or a column name holding the rate per row (as a
    dataset registry attaches it).  Rows with rate >= 1 are all kept.
    """
    by = list(by)
    x = df.withColumn("_shuf", seeded_key(id_col, seed))
    if by:
        # the first 60 bits of the key cut each group into even ranges
        x = x.withColumn("_range", F.conv(F.substring("_shuf", 1, 15), 16, 10).cast("bigint"))
        ranked = prefix_sums(x, by, "_range", ["_shuf", id_col], {name: F.lit(1).cast("bigint")}, width=44)
        ranked = ranked.drop("_shuf", "_range").join(row_count(df, by).withColumnRenamed("_cnt", "_n"), by)
    else:
        ranked = with_positions(x, ["_shuf", id_col], name=name).drop("_shuf")
        ranked = ranked.withColumn("_n", df.agg(F.count(F.lit(1))).scalar())
    n = F.col("_n")
    r = F.col(rate) if isinstance(rate, str) else F.lit(float(rate))
    keep = (r >= 1.0) | (F.col(name) < F.floor(n * r.cast("double")))
    return ranked.filter(keep).drop("_n")


def batch_assign(df: DataFrame, batch_size: int, order_by: Sequence, pos: str = "pos",
                 name: str = "batch") -> DataFrame:
    """Consecutive groups of ``batch_size`` rows in order."""
    return with_positions(df, order_by, name=pos).withColumn(
        name, F.floor(F.col(pos) / F.lit(batch_size)).cast("bigint"))


def next_row_fallback(positioned: DataFrame, key: str, pos: str = "pos", name: str = "fallback",
                      failed: str | None = None) -> DataFrame:
    """The sample that stands in for row i: row min(i + 1, n - 1).  With
    ``failed`` (a boolean column) only failed rows take it, others stay
    themselves, and a failed row whose stand-in failed too has none.

    A lead() over the global order would need one partition; an equi-join
    of position i + 1 against position does the same with a hash shuffle.
    """
    bad = F.coalesce(F.col(failed), F.lit(False)) if failed else F.lit(False)
    nxt = positioned.select((F.col(pos) - 1).alias("_prev_pos"), F.col(key).alias("_next"), bad.alias("_next_bad"))
    x = positioned.join(nxt, positioned[pos] == nxt["_prev_pos"], "left")
    if failed:
        good = F.when(~F.coalesce("_next_bad", F.lit(True)), F.col("_next"))
        x = x.withColumn(name, F.when(bad, good).otherwise(F.col(key)))
    else:
        x = x.withColumn(name, F.coalesce("_next", F.col(key)))
    return x.drop("_prev_pos", "_next", "_next_bad")


def running_sums(df: DataFrame, order_by: Sequence[str], by: Sequence[str], values: dict,
                 inclusive: bool = False) -> DataFrame:
    """Add, for each ``name -> Column`` in ``values``, the sum of that value
    over the rows before this one (``inclusive`` adds the row itself) within
    its ``by`` group, in ``order_by`` order: an integer column, then ties."""
    out = prefix_sums(df.withColumns({f"_own_{k}": v for k, v in values.items()}), list(by), order_by[0],
                      list(order_by[1:]), {k: F.col(f"_own_{k}") for k in values})
    if inclusive:
        out = out.withColumns({k: F.col(k) + F.col(f"_own_{k}") for k in values})
    return out.drop(*[f"_own_{k}" for k in values])


def sample_approx(df: DataFrame, rate: float, seed: int = 0) -> DataFrame:
    """Approximate mode of ``sample_exact``: an independent Bernoulli draw
    per row (no count, no shuffle); the size is ``rate * n`` on average."""
    if rate >= 1.0:
        return df
    return df.sample(withReplacement=False, fraction=float(rate), seed=seed)
