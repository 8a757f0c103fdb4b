"""Covariance by tall-skinny factorisation.

The rows of a group, less their mean, are a tall matrix X with few columns.
Every task reduces its rows to an upper triangle R with R'R = X'X (QR of what
it has and the next rows), triangles are stacked and reduced again in a tree of
bounded width, and one d x d triangle is left - however many rows there are.
Unlike a sum of squares, a triangle keeps the small directions of nearly
singular data.

The Frechet distance needs tr((S1 S2)^(1/2)), the sum of the singular values
of R1 R2' (the square roots of the eigenvalues of S1 S2, which is similar to
(R1 R2')(R1 R2')'): no root of a matrix that is not symmetric is taken.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import mean_array

FAN_IN = 8                       # triangles that one task of the tree reduces
STACK_BYTES = 64 << 20           # rows stacked on a triangle before the next reduction
TRIANGLE = "side string, part long, n long, r binary"


def _triangle(stack: list[np.ndarray]) -> np.ndarray:
    rows = np.vstack(stack)
    return np.linalg.qr(rows, mode="r") if len(rows) > rows.shape[1] else rows


def _record(side, part: int, n: int, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([side], pa.string()), pa.array([part], pa.int64()), pa.array([n], pa.int64()),
                                       pa.array([r.astype("<f8").tobytes()], pa.binary())], names=["side", "part", "n", "r"])


def _reduce_rows(means: dict, dim: int):
    """One triangle a side and task from rows (side, x)."""
    def run(batches):
        from pyspark import TaskContext
        part, held, n = TaskContext.get().partitionId(), {}, {}
        for batch in batches:
            sides = np.asarray(batch.column("side").to_pylist(), object)
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            for side in set(sides):
                rows = x[sides == side] - means[side]
                n[side] = n.get(side, 0) + len(rows)
                stack = held.setdefault(side, [])
                stack.append(rows)
                if sum(s.nbytes for s in stack) > STACK_BYTES:
                    held[side] = [_triangle(stack)]
        for side, stack in held.items():
            yield _record(side, part, n[side], _triangle(stack))
    return run


def _reduce_triangles(dim: int):
    """Triangles of equal (side, part), which come one after the other, into one."""
    def run(batches):
        key, stack, n = None, [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if (row["side"], row["part"]) != key:
                    if stack:
                        yield _record(*key, n, _triangle(stack))
                    key, stack, n = (row["side"], row["part"]), [], 0
                stack.append(np.frombuffer(row["r"], "<f8").reshape(-1, dim))
                n += row["n"]
                if len(stack) >= FAN_IN:
                    stack = [_triangle(stack)]
        if stack:
            yield _record(*key, n, _triangle(stack))
    return run


def triangles(df: DataFrame, vec: str, side: str) -> dict:
    """{side: (mean, number of rows, R)} with R'R the sum over the rows of
    (x - mean)(x - mean)'.  Rows of null ``side`` or vector are left out."""
    rows = df.select(F.col(side).cast("string").alias("side"), F.col(vec).cast("array<double>").alias("x")).dropna()
    means = {r["side"]: np.array(r["m"]) for r in rows.groupBy("side").agg(mean_array("x").alias("m")).collect()}   # one row a side
    if not means:
        return {}
    dim = len(next(iter(means.values())))
    level = rows.mapInArrow(_reduce_rows(means, dim), TRIANGLE)
    parts = rows.rdd.getNumPartitions()
    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        level = (level.withColumn("part", F.floor(F.col("part") / FAN_IN)).repartition(parts, "side", "part")
                 .sortWithinPartitions("side", "part").mapInArrow(_reduce_triangles(dim), TRIANGLE))
    out = {}
    for r in level.orderBy("side", "part").toLocalIterator():          # FAN_IN triangles a side, d x d each
        r0 = np.frombuffer(r["r"], "<f8").reshape(-1, dim)
        n, stack = out.get(r["side"], (0, []))
        out[r["side"]] = (n + r["n"], [_triangle([*stack, r0])])
    return {s: (means[s], n, stack[0]) for s, (n, stack) in out.items()}


def frechet_from_triangles(a: tuple, b: tuple) -> float:
    """||m1 - m2||^2 + tr(S1) + tr(S2) - 2 tr((S1 S2)^(1/2))."""
    (m1, n1, r1), (m2, n2, r2) = a, b
    scale1, scale2 = max(1, n1 - 1), max(1, n2 - 1)
    root = np.linalg.svd(r1 @ r2.T, compute_uv=False).sum() / np.sqrt(float(scale1) * scale2)
    d = m1 - m2
    return float(d @ d + (r1 ** 2).sum() / scale1 + (r2 ** 2).sum() / scale2 - 2 * root)


def frechet_distance(df: DataFrame, vec: str, side: str, real, generated) -> float:
    got = triangles(df.filter(F.col(side).isin(real, generated)), vec, side)
    return frechet_from_triangles(got[str(real)], got[str(generated)])
