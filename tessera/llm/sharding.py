"""Sharding by balanced label propagation.

Linked documents (one link group per document: equal texts, or any key that
the caller gives) move towards the shard in which most of their group already is.  Every round is a
few joins and aggregations over narrow rows: votes by (group, shard), the
favourite shard of each group, the wish matrix (from, to).  The matrix - the
square of the number of shards, whatever the input - is turned into quotas on
the driver so that the law stays exact: what a shard takes in beyond what
leaves it is balanced by unlinked documents that move to the shards with room.
A group larger than a quarter of a shard is cut into units of that size, which
move by themselves, so a group with a third of all rows spreads evenly.

Law ``rows``: the counts of any two shards are at most one apart, from the
first assignment on.

Documents start in turn, one shard after the other, in the order of the input
where the caller gives it (``order``), and have their slots in that order; else
in a hash order.

Defined results: a null text has no bytes and is linked with empty texts; a
null link links with nothing; null or repeated doc_ids and repeated rows are rows like others (every row gets its
own slot); extra columns are carried through, and a column of the input with
the name of an added one is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.prefix import positions, prefix_sums
from ._store import drop, release, saved

SHARDS, ROUNDS = 40, 8


def quotas(wish: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """(accepted moves by (from, to), moves of unlinked rows (from, to, how
    many)) such that every shard keeps its number of rows.  ``wish``: linked
    rows that want to move, ``free``: unlinked rows of each shard."""
    take = wish.copy()
    np.fill_diagonal(take, 0)
    while True:
        over = take.sum(0) - take.sum(1) - free
        j = int(over.argmax())
        if over[j] <= 0:
            break
        i = int(take[:, j].argmax())
        take[i, j] -= min(take[i, j], over[j])
    net = take.sum(0) - take.sum(1)
    give = [[j, int(x)] for j, x in enumerate(net) if x > 0]
    room = [[j, int(-x)] for j, x in enumerate(net) if x < 0]
    fill = []
    while give:
        k = min(give[-1][1], room[-1][1])
        fill.append((give[-1][0], room[-1][0], k))
        for side in (give, room):
            side[-1][1] -= k
            if not side[-1][1]:
                side.pop()
    return take, fill


def placed_in(rows: DataFrame, by: list[str], key: list[str], order: str | None, name: str, seed: int = 0) -> DataFrame:
    """``name``: 0-based place of each row among those with its ``by`` values,
    by the column ``order`` or in a hash order of ``key``."""
    if order is None:
        return positions(rows, by, key, name, seed)
    return prefix_sums(rows, by, order, key, {name: F.lit(1).cast("long")}, width=20)


def balance(rows: DataFrame, group: str, key: list[str], n_shards: int = SHARDS, rounds: int = ROUNDS,
            order: str | None = None) -> DataFrame:
    """``rows`` with ``shard``: label propagation under the law ``rows``."""
    spark = rows.sparkSession
    start = placed_in(rows, [], key, order, "_p").withColumn("shard", (F.col("_p") % n_shards).cast("int"))
    total = rows.count()
    unit_rows = max(2, total // n_shards // 4)
    start = positions(start, [group], key, "_p", seed=1)
    state = start.withColumn("unit", F.xxhash64(group, F.floor(F.col("_p") / unit_rows))).drop("_p")
    sizes = state.groupBy("unit").agg(F.count(F.lit(1)).alias("_k")).filter("_k > 1").select("unit", F.lit(True).alias("linked"))
    state = saved(state.join(sizes, "unit", "left").withColumn("linked", F.coalesce("linked", F.lit(False))), "shards")
    for _ in range(rounds):
        votes = state.filter("linked").groupBy("unit", "shard").agg(F.count(F.lit(1)).alias("k"))
        goal = votes.groupBy("unit").agg(
            F.max_by("shard", F.struct("k", F.xxhash64("unit", "shard"))).alias("goal"))
        wish = saved(state.join(goal, "unit", "left").withColumn(
            "to", F.when(F.col("linked"), F.col("goal")).otherwise(F.lit(-1))).drop("goal"), "wishes")
        matrix, free = np.zeros((n_shards, n_shards), np.int64), np.zeros(n_shards, np.int64)
        for r in wish.groupBy("shard", "to").agg(F.count(F.lit(1)).alias("n")).collect():   # <= shards * (shards + 1)
            if r["to"] < 0:
                free[r["shard"]] = r["n"]
            else:
                matrix[r["shard"], r["to"]] = r["n"]
        take, fill = quotas(matrix, free)
        moves = [(int(i), int(j), 0, int(take[i, j]), int(j)) for i, j in zip(*np.nonzero(take))]
        at: dict = {}
        for i, j, k in fill:
            moves.append((i, -1, at.get(i, 0), at.get(i, 0) + k, j))
            at[i] = at.get(i, 0) + k
        if not moves:
            drop(state)
            return wish.drop("to", "unit", "linked")
        plan = spark.createDataFrame(moves, "shard int, to int, lo long, hi long, go int")
        ranked = positions(wish, ["shard", "to"], key, "_p", seed=2)
        new = ranked.join(F.broadcast(plan.withColumnsRenamed({"shard": "_s", "to": "_t"})),
                          (F.col("shard") == F.col("_s")) & (F.col("to") == F.col("_t"))
                          & (F.col("_p") >= F.col("lo")) & (F.col("_p") < F.col("hi")), "left")
        new = saved(new.withColumn("shard", F.coalesce("go", "shard"))
                    .drop("to", "_p", "_s", "_t", "lo", "hi", "go"), "shards")
        drop(state)
        drop(wish)
        release(spark)
        state = new
    return state.drop("unit", "linked")


def shard_documents(docs: DataFrame, n_shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text",
                    rounds: int = ROUNDS, link: Column | None = None, order: Column | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) per row.

    ``link``: documents with the same value (a long) are linked, by default
    those of equal text.  ``order``: a long by which they are dealt and slots
    are numbered."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    group = F.xxhash64(body) if link is None else F.coalesce(link, F.xxhash64(F.lit("own"), F.col(f"`{doc_id}`"), body))
    more = [] if order is None else [order.cast("long").alias("_order")]
    rows = saved(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), (F.octet_length(body) + 16).cast("long").alias("size"),
                             F.crc32(F.encode(body, "UTF-8")).cast("long").alias("text_crc32"),
                             group.alias("_group"), *more), "sizes")
    by = None if order is None else "_order"
    placed = balance(rows, "_group", ["doc_id", "_group"], n_shards, rounds, by)
    out = placed_in(placed, ["shard"], ["doc_id", "_group"], by, "slot", seed=3)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def file_order(docs: DataFrame, columns: tuple = ("doc_id", "text")) -> tuple[DataFrame, Column | None]:
    """``columns`` of ``docs`` and, as a column, a long that gives the place of
    each row in the files that ``docs`` is read from (files by name); None
    where it is not read from files."""
    own = [F.col(f"`{c}`") for c in columns]
    if not docs.inputFiles():
        return docs.select(*own), None
    rows = docs.select(*own, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    files = docs.select(F.col("_metadata.file_path").alias("_path")).distinct()
    number = files.select("_path", (F.row_number().over(Window.orderBy("_path")) - 1).cast("long").alias("_number"))   # one row a file
    rows = rows.join(F.broadcast(number), F.col("_file") == F.col("_path"))
    return rows, F.shiftleft(F.col("_number"), 36) + F.col("_at")


def op5_label_propagation(spark, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
