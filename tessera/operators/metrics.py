"""Evaluation aggregates over feature / probability vectors.

Means, covariances, Inception Score and CLIP score are distributed
aggregations: every row contributes partial sums that Spark merges
map-side before the shuffle, so the exchange carries one partial state per
(partition, group) and never the rows.  The Fréchet distance is in
``factor``.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V

IS_EPS = 1e-16
CLIP_SCALE = 2.5


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def mean_array(vec) -> Column:
    """Element-wise mean of an array column as an aggregate (one d-vector of
    state per group and task)."""
    return vector_to_array(Summarizer.mean(array_to_vector(V._d(vec))))


def mean_vector(df: DataFrame, vec: str, by: Sequence[str] = ()) -> DataFrame:
    return (df.groupBy(*by).agg(mean_array(vec).alias("_m"))
            .select(*by, F.posexplode("_m").alias("dim", "mean")))


def covariance_long(df: DataFrame, vec: str, by: Sequence[str] = ()) -> DataFrame:
    """Sample covariance (ddof 1) per (by, i, j)."""
    return moments(df, vec, by).select(*by, "i", F.posexplode("cov").alias("j", "cov"))


def moments(df: DataFrame, vec: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, i, n, mean_i, cov): one row per group and matrix row, ``cov`` the
    row of the sample covariance matrix.

    Two passes.  The first is an aggregate of means.  In the second every
    task sums (x - m)(x - m)' per group, centred on the group's mean m - so
    nothing cancels, however large the means are - and sends one row per
    matrix row; these are added up as they arrive.
    """
    by = list(by)
    if not by:
        return moments(df.withColumn("_g", F.lit(0)), vec, ["_g"]).drop("_g")
    means = df.groupBy(*[F.col(c).alias(f"_k_{c}") for c in by]).agg(mean_array(vec).alias("_mean"))
    keyed = (df.select(*by, F.col(vec).alias("_x")).join(means, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by])
             .select(*by, "_x", "_mean"))
    cells = T.StructType([*(df.schema[c] for c in by), T.StructField("i", T.IntegerType()),
                          T.StructField("n", T.LongType()), T.StructField("mean_i", T.DoubleType()),
                          T.StructField("row", T.ArrayType(T.DoubleType()))])

    def part(it):
        acc: dict = {}
        for pdf in it:
            for k, g in pdf.groupby(by, sort=False, dropna=False):
                mean = np.asarray(g["_mean"].iloc[0], float)
                c = np.vstack(g["_x"].to_numpy()).astype(float) - mean
                n, _, m2 = acc.get(k, (0, None, 0.0))
                acc[k] = (n + len(c), mean, m2 + c.T @ c)
        for k, (n, mean, m2) in acc.items():
            yield pd.DataFrame({**{c: [v] * len(mean) for c, v in zip(by, k)}, "i": np.arange(len(mean), dtype="int32"),
                                "n": n, "mean_i": mean, "row": list(m2)})

    def add(it):
        acc: dict = {}
        for pdf in it:
            for r in pdf.itertuples(index=False):
                k = tuple(r[:len(by) + 1])
                n, _, row = acc.get(k, (0, 0.0, 0.0))
                acc[k] = (n + r.n, r.mean_i, row + np.asarray(r.row))
        for k, (n, mean, row) in acc.items():
            yield pd.DataFrame([(*k, n, mean, row / (n - 1) if n > 1 else None)], columns=[*by, "i", "n", "mean_i", "cov"])

    out = T.StructType([*cells.fields[:-1], T.StructField("cov", T.ArrayType(T.DoubleType()))])
    return keyed.mapInPandas(part, cells).repartition(*by, "i").mapInPandas(add, out)


def inception_score(df: DataFrame, probs: str, by: Sequence[str] = (), eps: float = IS_EPS) -> DataFrame:
    """exp(mean_i KL(p_i || p_bar)) in one pass per group:
    mean_i sum_k p_ik ln(p_ik + eps) - sum_k p_bar_k ln(p_bar_k + eps),
    exact because the mean over rows of p is p_bar."""
    by = list(by)
    if not by:
        return inception_score(df.withColumn("_g", F.lit(0)), probs, ["_g"], eps).drop("_g")
    one = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(V.plogp_sum(F.col(probs), eps)).alias("h_row"),
                              mean_array(probs).alias("pbar"))
    return one.select(*by, "n", F.exp(F.col("h_row") - V.plogp_sum(F.col("pbar"), eps)).alias("inception_score"))


def clip_score(df: DataFrame, img: str, txt: str, by: Sequence[str] = ()) -> DataFrame:
    """2.5 * mean over pairs of max(cos(l2(img), l2(txt)), 0)."""
    cos = V.dot(V.l2_normalize(img), V.l2_normalize(txt))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_pairs"),
                               (F.avg(F.greatest(cos, F.lit(0.0))) * F.lit(CLIP_SCALE)).alias("clip_score"))


def report(df: DataFrame, probs: str, img: str, txt: str, by: Sequence[str]) -> DataFrame:
    """Inception Score of every group and CLIP score of the rows with a text
    vector, in one aggregation."""
    has = F.col(txt).isNotNull()
    cos = F.greatest(V.dot(V.l2_normalize(img), V.l2_normalize(F.coalesce(F.col(txt), F.col(img)))), F.lit(0.0))
    one = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(V.plogp_sum(F.col(probs), IS_EPS)).alias("h_row"),
                              mean_array(probs).alias("pbar"), (F.avg(F.when(has, cos)) * CLIP_SCALE).alias("clip_score"))
    return one.select(*by, "n", F.exp(F.col("h_row") - V.plogp_sum(F.col("pbar"), IS_EPS)).alias("inception_score"),
                      "clip_score")
