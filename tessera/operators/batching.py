"""Batch assembly over per-sample tables: padding, packing, media gather.

Samples get batch numbers from the distributed position operator; every
later step is a window or aggregation partitioned by batch, so batches
spread over tasks and none holds more than its own samples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MODEL_MAX_LENGTH = 512


def pad_batch(spans: DataFrame, max_len: int = MODEL_MAX_LENGTH) -> DataFrame:
    """Right-pad to the batch maximum, then cut to ``max_len``: padded
    length, attended tokens (ids differ from the pad id) and supervised
    labels that survive the cut (``n_supervised_kept`` of the spans)."""
    wb = Window.partitionBy("batch")
    x = spans.withColumn("padded_len", F.least(F.max("seq_len").over(wb), F.lit(max_len)).cast("bigint"))
    return x.withColumn("n_attended", F.least(F.col("seq_len"), F.lit(max_len)).cast("bigint"))


def pad_token_rows(tokens: DataFrame, spans: DataFrame, key: str, pad_id: int, max_len: int = MODEL_MAX_LENGTH) -> DataFrame:
    """(batch, key, pos, id, label, mask): the tokens of a batch right-padded
    to its longest sample and cut to ``max_len``.  The mask is by value - a
    token that equals the pad id is masked wherever it stands."""
    w = Window.partitionBy("batch")
    b = spans.select(key, "batch", "seq_len", F.least(F.max("seq_len").over(w), F.lit(max_len)).alias("_len"))
    real = tokens.filter(F.col("pos") < max_len).join(b.select(key, "batch"), key).select("batch", key, "pos", "id", "label")
    pads = b.filter("seq_len < _len").select(
        "batch", key, F.explode(F.sequence(F.col("seq_len"), F.col("_len") - 1)).alias("pos"),
        F.lit(pad_id).cast("bigint").alias("id"), F.lit(-100).cast("bigint").alias("label"))
    return real.unionByName(pads).withColumn("mask", (F.col("id") != pad_id).cast("int"))


def pack_token_rows(tokens: DataFrame, packed: DataFrame, key: str) -> DataFrame:
    """(batch, pos, id, label): the samples of a batch one after the other."""
    return tokens.join(packed.select(key, "batch", "cu_start"), key).select(
        "batch", (F.col("cu_start") + F.col("pos")).cast("bigint").alias("pos"), "id", "label")


def pack_batch(lengths: DataFrame, key: str, order: str = "pos") -> DataFrame:
    """Concatenate the batch: cumulative offsets [0, l1, l1+l2, ...] and the
    longest segment; no cut to the model limit."""
    w = Window.partitionBy("batch").orderBy(order)
    end = F.sum("seq_len").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (lengths.withColumn("cu_end", end.cast("bigint"))
            .withColumn("cu_start", (F.col("cu_end") - F.col("seq_len")).cast("bigint"))
            .withColumn("max_seqlen", F.max("seq_len").over(Window.partitionBy("batch")).cast("bigint")))


def batch_media(samples: DataFrame, media: DataFrame, key: str, order: str = "pos") -> DataFrame:
    """Ordered concat of a batch's images and videos (null when none) and
    their visual token totals.  ``media``: (key, kind, turn, file, tokens)."""
    m = media.join(samples.select(key, "batch", order), key)
    o = F.struct(F.col(order).alias("o"), F.col("turn").alias("t"), F.col("file").alias("f"))
    g = m.groupBy("batch").agg(
        F.sort_array(F.collect_list(F.when(F.col("kind") == "image", o))).alias("im"),
        F.sort_array(F.collect_list(F.when(F.col("kind") == "video", o))).alias("vi"),
        F.sum(F.when(F.col("kind") == "image", F.col("tokens"))).cast("bigint").alias("image_tokens"),
        F.sum(F.when(F.col("kind") == "video", F.col("tokens"))).cast("bigint").alias("video_tokens"))
    b = samples.select("batch").distinct().join(g, "batch", "left")
    return b.select("batch",
                    F.nullif(F.array_join(F.transform("im", lambda z: z["f"]), ","), F.lit("")).alias("images"),
                    F.nullif(F.array_join(F.transform("vi", lambda z: z["f"]), ","), F.lit("")).alias("videos"),
                    "image_tokens", "video_tokens")


def pad_position_rows(positions: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """3-D positions padded with 1 to the batch maximum (positions are not
    cut to the model limit)."""
    b = spans.withColumn("_bmax", F.max("seq_len").over(Window.partitionBy("batch")))
    pad = b.filter(F.col("_bmax") > F.col("seq_len")).select(
        key, F.explode(F.sequence("seq_len", F.col("_bmax") - 1)).alias("pos"))
    one = [F.lit(1).cast("bigint").alias(a) for a in ("t", "h", "w")]
    return positions.select(key, "pos", "t", "h", "w").unionByName(pad.select(key, "pos", *one))


def text_positions(spans: DataFrame, key: str, max_len: int = MODEL_MAX_LENGTH) -> DataFrame:
    """Text positions of the padded, cut batch: the number of attended tokens
    before each one, 1 in the padding (attended tokens come first)."""
    b = spans.withColumn("_len", F.least(F.max("seq_len").over(Window.partitionBy("batch")), F.lit(max_len)))
    x = b.select(key, "seq_len", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_len") - 1)).alias("pos"))
    return x.select(key, "pos", F.when(F.col("pos") < F.col("seq_len"), F.col("pos")).otherwise(F.lit(1))
                    .cast("bigint").alias("position_id"))
