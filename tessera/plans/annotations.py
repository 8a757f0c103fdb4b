"""Annotation documents derived from the conversations table.

Even conversations are written in the documented from/value form with
record-level ``image``/``images``/``video``/``videos``; odd ones in the
role/content form with typed segment lists (image, text, video and an
unknown ``audio`` type), every fifth of these as a bare list of turns without
a record around it (and so without an id).  ``validation_form`` writes every record in the
from/value form the validator reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixtures as FX

SEG = "struct<type:string,text:string,image:string,image_url:string,video:string,audio:string>"


def _seg(typ: str, **kw) -> Column:
    fields = {k: F.lit(None).cast("string") for k in ("text", "image", "image_url", "video", "audio")}
    fields.update(kw)
    return F.struct(F.lit(typ).alias("type"), *[v.alias(k) for k, v in fields.items()])


def _records(t) -> DataFrame:
    tr = FX.turns(t)
    segs = F.array_compact(F.array(
        F.when(F.col("has_img"), _seg("image", image=F.col("image_file"))),
        _seg("text", text=F.col("seg_text")),
        F.when(F.col("has_vid"), _seg("video", video=F.col("video_file"))),
        F.when(F.col("has_audio"), _seg("audio", audio=F.concat(
            F.lit("media/aud_"), F.col("conv_id").cast("string"), F.lit(".wav"))))))
    frm = (F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt")
           .otherwise(F.col("role")))
    item = F.struct(F.col("turn").alias("turn"),
                    F.struct(frm.alias("from"), F.col("flat").alias("value")).alias("fv"),
                    F.struct(F.col("role").alias("role"), segs.alias("content")).alias("rc"),
                    F.when(F.col("has_img"), F.col("image_file")).alias("img"),
                    F.when(F.col("has_vid"), F.col("video_file")).alias("vid"))
    return (tr.groupBy("conv_id", "form").agg(F.sort_array(F.collect_list(item)).alias("items"))
            .withColumn("images", F.filter(F.transform("items", lambda x: x["img"]), lambda s: s.isNotNull()))
            .withColumn("videos", F.filter(F.transform("items", lambda x: x["vid"]), lambda s: s.isNotNull())))


def _media_fields(arr: str, single: str, plural: str) -> list[Column]:
    n = F.size(arr)
    return [F.when(n == 1, F.col(arr)[0]).alias(single), F.when(n > 1, F.col(arr)).alias(plural)]


def _from_value_json() -> Column:
    return F.to_json(F.struct(
        F.col("conv_id").alias("id"),
        F.transform("items", lambda x: x["fv"]).alias("conversations"),
        *_media_fields("images", "image", "images"), *_media_fields("videos", "video", "videos")))


def _role_content_json() -> Column:
    return F.to_json(F.struct(F.col("conv_id").alias("id"),
                              F.transform("items", lambda x: x["rc"]).alias("conversations")))


#: role/content conversations that are written as a bare list
BARE = "conv_id % 10 = 3"


def mixed_lines(t) -> DataFrame:
    r = _records(t)
    line = (F.when(F.col("form") == "from_value", _from_value_json())
            .when(F.expr(BARE), F.to_json(F.transform("items", lambda x: x["rc"]))).otherwise(_role_content_json()))
    return r.select("conv_id", line.alias("line"))


def keyless_lines(t) -> DataFrame:
    """Every record in the from/value form without an id, those of every
    fourth conversation twice, in the order of the conversations."""
    r = _records(t).select("conv_id", F.to_json(F.struct(
        F.transform("items", lambda x: x["fv"]).alias("conversations"),
        *_media_fields("images", "image", "images"), *_media_fields("videos", "video", "videos"))).alias("line"))
    twice = r.withColumn("_copies", F.when(F.col("conv_id") % 4 == 1, 2).otherwise(1))
    return (twice.select("conv_id", "line", F.explode(F.sequence(F.lit(1), "_copies")).alias("copy"))
            .repartitionByRange("conv_id").sortWithinPartitions("conv_id", "copy"))


def validation_lines(t) -> DataFrame:
    return _records(t).select("conv_id", _from_value_json().alias("line"))
