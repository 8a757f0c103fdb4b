"""Pair scoring and ranking."""

from __future__ import annotations

from typing import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V


def pair_cosine(df: DataFrame, a: str, b: str, out: str = "similarity") -> DataFrame:
    """``cosine_similarity(img, txt, dim=1)`` per row, in double."""
    return df.withColumn(out, V.cosine(a, b))


def rank_order(score: str, key: str) -> list:
    """Descending score, NaN treated as missing and placed last, ties by key
    (an order for ``rows.with_positions``)."""
    s = F.when(F.isnan(F.col(score)), F.lit(None)).otherwise(F.col(score))
    return [(s, "desc_nulls_last"), key]


def batch_score(df: DataFrame, make_predict_fn: Callable, input_col: str, dim: int,
                out: str = "score", batch_size: int = 64, status: str | None = None) -> DataFrame:
    """Model scoring hook: Arrow batches of ``batch_size`` rows go through
    ``make_predict_fn()`` (loaded once per Python worker).  A batch whose
    call raises yields nulls for its rows (the reference drops the batch);
    filter them with :func:`tessera.operators.text.drop_failed`.  ``status`` names
    a column that tells ``scored`` from ``failed`` rows: a row for which the
    model itself gives NaN has no score either, but was scored."""
    from pyspark.ml.functions import predict_batch_udf

    def make():
        fn = make_predict_fn()

        def predict(x: np.ndarray) -> dict:
            try:
                got = np.asarray(fn(x), dtype="float64")
                return {"score": got, "failed": np.zeros(len(got), "int32")}
            except Exception:  # failed batch -> missing scores
                return {"score": np.zeros(x.shape[0]), "failed": np.ones(x.shape[0], "int32")}
        return predict

    kind = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("failed", T.IntegerType())])
    udf = predict_batch_udf(make, return_type=kind, batch_size=batch_size, input_tensor_shapes=[[dim]])
    x = df.withColumn("_scored", udf(F.col(input_col).cast("array<float>")))
    ok = F.col("_scored.failed") == 0
    more = {status: F.when(ok, "scored").otherwise("failed")} if status else {}
    return x.withColumns({out: F.when(ok, F.col("_scored.score")), **more}).drop("_scored")


def projection_model(dim: int, seed: int = 7) -> Callable:
    """A fixed random projection + logistic, standing in for a model in
    offline runs (the real network stays outside, see README)."""
    def make():
        w = np.random.default_rng(seed).standard_normal(dim)

        def fn(x: np.ndarray) -> np.ndarray:
            return 1.0 / (1.0 + np.exp(-(x @ w)))
        return fn
    return make
