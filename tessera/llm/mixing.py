"""Mixing sources to target weights by Pfair scheduling.

The rows of a source, in a seeded hash order, are cut into blocks.  The
target weights are whole parts w of D in all; block j of a source has the
release time floor(j*D/w) and the deadline ceil((j+1)*D/w), and in every slot
the released block with the earliest deadline is taken.  One task set with
total weight 1 always meets its deadlines, so at every slot each source has
had its share of blocks to within less than one block, as long as all sources
have blocks.  The schedule repeats after D slots: one cycle is worked out from
the weights alone, whatever the number of rows, and every block finds its slot
by arithmetic.  When a source runs out its slots stay empty, and the others
keep their weights among themselves.

Weights: given ones are taken as exact fractions (a float stands for the
simplest fraction that it rounds to), so {9, 1} is 90 and 10 in every 100
slots and 1/3 is a third for ever.  Only if they have no common unit of
1/``MAX_PARTS`` are they rounded to that unit (half a block in ``MAX_PARTS``
slots).  Without given weights the parts follow rows ** temperature.  There may
be as many sources as parts; more raise an error.

The rows pass through DataFrame and SQL functions only.

Defined results: a null source is the source ``''``; a source without a weight,
or of weight 0, has no place in the mix: its rows have null ``slot``,
``release`` and ``deadline`` and come last; null doc_ids are ordered like any
value; repeated rows keep their own positions; every row stays, once; extra
columns are carried through, and a column of the input with the name of an
added one is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import math
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prefix import positions

BLOCK_ROWS, TEMPERATURE = 16, 0.5
MAX_PARTS = 1 << 20          # slots of a cycle; bounds the schedule that is broadcast (4 bytes each)
PARTS = 100                  # of the largest source, without given weights
ADDED = ["block", "in_block", "slot", "release", "deadline"]


def simplest(x: float | int | Fraction) -> Fraction:
    """The fraction of least denominator that rounds to ``x``."""
    if not isinstance(x, float):
        return Fraction(x)
    for limit in (10, 1000, 10 ** 6, 10 ** 9):
        f = Fraction(x).limit_denominator(limit)
        if float(f) == x:
            return f
    return Fraction(x)


def parts_of(weights: dict[str, float]) -> dict[str, int]:
    """Whole parts in the proportion of the positive ``weights``, at most
    ``MAX_PARTS`` in all: exact where they have such a unit, else the largest
    remainders, at least one part each."""
    exact = {k: simplest(v) for k, v in weights.items()}
    if any(v < 0 for v in exact.values()):
        raise ValueError("a weight is negative")
    exact = {k: v for k, v in sorted(exact.items()) if v}
    if len(exact) > MAX_PARTS:
        raise ValueError(f"more than {MAX_PARTS} sources with a weight")
    if not exact:
        return {}
    unit = math.lcm(*(v.denominator for v in exact.values()))
    whole = {k: int(v * unit) for k, v in exact.items()}
    by = math.gcd(*whole.values())
    whole = {k: v // by for k, v in whole.items()}
    total = sum(whole.values())
    if total <= MAX_PARTS:
        return whole
    free = MAX_PARTS - sum(1 for v in whole.values() if v * MAX_PARTS < total)
    big = {k: v for k, v in whole.items() if v * MAX_PARTS >= total}
    share = {k: Fraction(v * free, sum(big.values())) for k, v in big.items()}
    out = {k: max(1, int(share.get(k, 0))) for k in whole}
    left = MAX_PARTS - sum(out.values())
    for k in sorted(share, key=lambda k: (int(share[k]) - share[k], k))[:max(0, left)]:
        out[k] += 1
    return out


def schedule(parts: list[int]) -> list[list[int]]:
    """The slots of each source in one cycle: earliest deadline first among
    the released blocks."""
    d = sum(parts)
    out: list[list[int]] = [[] for _ in parts]
    waiting, ready = [(0, s) for s in range(len(parts))], []
    heapq.heapify(waiting)
    for t in range(d):
        while waiting and waiting[0][0] <= t:
            s = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(len(out[s]) + 1) * d // parts[s]), s))
        s = heapq.heappop(ready)[1]
        out[s].append(t)
        if len(out[s]) < parts[s]:
            heapq.heappush(waiting, (len(out[s]) * d // parts[s], s))
    return out


def cycle(spark: SparkSession, parts: dict[str, int]) -> DataFrame:
    """(_name, _w, _d, _slots): the schedule as a table, one row a source."""
    names = list(parts)
    rows = [{"_name": k, "_w": parts[k], "_slots": s} for k, s in zip(names, schedule([parts[k] for k in names]))]
    table = spark.range(1).select(F.explode(F.from_json(
        F.lit(json.dumps(rows)), "array<struct<_name string, _w long, _slots array<int>>>")).alias("x")).select("x.*")
    return table.withColumn("_d", F.lit(sum(parts.values())).cast("long"))


def target_parts(names: DataFrame, temperature: float) -> dict[str, int]:
    """Parts of the sources by their rows ** temperature, the largest has
    ``PARTS`` (fewer where many sources share ``MAX_PARTS``)."""
    counts = names.groupBy("_name").agg(F.count(F.lit(1)).alias("n")).limit(MAX_PARTS + 1).collect()    # one row a source
    if len(counts) > MAX_PARTS:
        raise ValueError(f"more than {MAX_PARTS} sources")
    if not counts:
        return {}
    most, top = max(1, min(PARTS, MAX_PARTS // len(counts))), max(r["n"] for r in counts)
    return {r["_name"]: max(1, round(most * (r["n"] / top) ** temperature)) for r in sorted(counts)}


def mix_sources(docs: DataFrame, weights: dict | None = None, source: str = "source", doc_id: str = "doc_id",
                block_rows: int = BLOCK_ROWS, temperature: float = TEMPERATURE, seed: int = 0) -> DataFrame:
    """``docs`` with block (number within the source), in_block, slot,
    release and deadline.  The mix is the order of (slot, in_block).

    ``weights``: target weight by source (null is ``''``); without it, weights
    follow rows ** temperature."""
    keep = [c for c in docs.columns if c not in ADDED]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                       F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("_name"), F.col(f"`{doc_id}`").alias("_key"))
    if weights is None:
        parts = target_parts(rows.select("_name"), temperature)
    else:
        parts = parts_of({k or "": v for k, v in weights.items()})
    rows = positions(rows, ["_name"], ["_key"], "_pos", seed)
    # bounded: MAX_PARTS slots in all
    rows = rows.join(F.broadcast(cycle(docs.sparkSession, parts)), "_name", "left").withColumn("_block", F.floor(F.col("_pos") / block_rows))
    added = {"block": "_block", "in_block": f"CAST(_pos % {int(block_rows)} AS INT)",
             "slot": "(_block div _w) * _d + _slots[CAST(_block % _w AS INT)]", "release": "(_block * _d) div _w",
             "deadline": "((_block + 1) * _d + _w - 1) div _w"}
    return rows.select(*[F.col("_row")[c].alias(c) for c in keep],
                       *[F.expr(e).cast("int" if c == "in_block" else "long").alias(c) for c, e in added.items()])


def in_mix_order(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, all of them, in the order of the mix."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_whole"),
                      *[F.col(f"`{how.get(k, k)}`").alias(k) for k in ("source", "doc_id")])
    mixed = mix_sources(row, **{k: v for k, v in how.items() if k not in ("source", "doc_id")})
    order = [F.col("slot").asc_nulls_last(), "block", "in_block"]
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order).select("_whole.*")


def op3_pfair_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return mix_sources(docs)
