"""Annotation validation: media fields, existence against a media listing,
placeholder consistency, answer tags, valid/problem split and summary.

Existence is a join of the exploded media references against the listing
(left_anti), never a per-row filesystem probe; AQE picks broadcast or
sort-merge from the listing's runtime size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..session import ensure_checkpoint_dir
from .bloom import without_partner


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def media_list(v, single: str, plural: str) -> Column:
    """``image`` or ``images`` (coalesced); a string becomes a 1-list,
    anything else an empty list."""
    v = _c(v)
    s = F.try_variant_get(v, f"$.{single}", "variant")
    p = F.try_variant_get(v, f"$.{plural}", "variant")
    x = F.when(s.isNotNull() & ~F.is_variant_null(s), s).otherwise(p)
    k = F.schema_of_variant(x)
    return (F.when(k == "STRING", F.array(F.try_variant_get(x, "$", "string")))
            .when(k.startswith("ARRAY"), F.coalesce(F.try_variant_get(x, "$", "array<string>"),
                                                    F.array().cast("array<string>")))
            .otherwise(F.array().cast("array<string>")))


def from_value_turns(v) -> Column:
    """``conversations`` as (from, value) pairs; missing keys are null."""
    convs = F.coalesce(F.try_variant_get(_c(v), "$.conversations", "array<variant>"),
                       F.array().cast("array<variant>"))
    return F.transform(convs, lambda t: F.struct(
        F.try_variant_get(t, "$.from", "string").alias("from"),
        F.coalesce(F.try_variant_get(t, "$.value", "string"), F.lit("")).alias("value")))


def prepare(df: DataFrame, v: str = "v") -> DataFrame:
    """Add images, videos, tag counts and the answer-tag flag."""
    turns = from_value_turns(v)
    human = F.filter(turns, lambda t: t["from"] == "human")
    gpt = F.filter(turns, lambda t: t["from"] == "gpt")

    def tags(tag):
        return F.aggregate(human, F.lit(0).cast("bigint"), lambda a, t: a + T.count_occurrences(t["value"], tag))

    return df.withColumns({
        "images": media_list(v, "image", "images"),
        "videos": media_list(v, "video", "videos"),
        "image_tags": tags(K.IMAGE_TAG),
        "video_tags": tags(K.VIDEO_TAG),
        "gpt_media_token": F.exists(gpt, lambda t: t["value"].contains(K.IMAGE_TAG)
                                    | t["value"].contains(K.VIDEO_TAG))})


def media_type(images, videos) -> Column:
    ni, nv = F.size(_c(images)), F.size(_c(videos))
    return (F.when((ni > 0) & (nv > 0), "mixed").when(ni > 0, "image").when(nv > 0, "video"))


def media_paths(df: DataFrame, key: str, root: str) -> DataFrame:
    """One row per media reference: (key, k, path), images first."""
    files = F.concat(F.col("images"), F.col("videos"))
    x = df.select(key, F.posexplode(files).alias("k", "file"))
    path = F.when(F.col("file").startswith("/"), F.col("file")).otherwise(
        F.concat(F.lit(root.rstrip("/") + "/"), F.col("file")))
    return x.select(key, "k", path.alias("path"))


def missing_media(df: DataFrame, key: str, listing: DataFrame, root: str, by_filter: bool = False) -> DataFrame:
    """Per record with missing files: ordered list of missing paths.  With
    ``by_filter`` only references that a Bloom filter of the listing has are
    joined with it: for large tables of which much is missing."""
    paths = media_paths(df, key, root)
    if by_filter:
        miss = without_partner(paths, listing, "path", "path")
    else:
        miss = paths.join(listing.select("path").distinct(), "path", "left_anti")
    return (miss.groupBy(key)
            .agg(F.sort_array(F.collect_list(F.struct("k", "path"))).alias("_m"))
            .select(key, F.transform("_m", lambda z: z["path"]).alias("missing_files")))


def problems(df: DataFrame, key: str, listing: DataFrame, root: str, v: str = "v") -> DataFrame:
    """Adds ``missing_files``, the first token mismatch, and
    ``validation_problems`` in a fixed order.  The message texts are fixed
    values."""
    miss = missing_media(df, key, listing, root)
    x = df.join(miss, key, "left")
    ni, nv = F.size("images").cast("bigint"), F.size("videos").cast("bigint")
    img_bad = F.col("image_tags") != ni
    vid_bad = F.col("video_tags") != nv
    mm_type = F.when(img_bad, "image").when(vid_bad, "video")
    exp = F.when(img_bad, ni).when(vid_bad, nv)
    act = F.when(img_bad, F.col("image_tags")).when(vid_bad, F.col("video_tags"))
    prob_t = "struct<type:string,media_type:string,expected:bigint,actual:bigint,files:array<string>,message:string>"
    p_missing = F.when(F.size(F.coalesce("missing_files", F.array())) > 0, F.struct(
        F.lit("missing_files").alias("type"), F.lit(None).cast("string").alias("media_type"),
        F.lit(None).cast("bigint").alias("expected"), F.lit(None).cast("bigint").alias("actual"),
        F.col("missing_files").alias("files"),
        F.concat(F.lit("Missing media files: "), F.array_join("missing_files", ", ")).alias("message"))).cast(prob_t)
    p_mismatch = F.when(mm_type.isNotNull(), F.struct(
        F.lit("token_mismatch").alias("type"), mm_type.alias("media_type"), exp.alias("expected"),
        act.alias("actual"), F.lit(None).cast("array<string>").alias("files"),
        F.concat(F.lit("Expected "), exp.cast("string"), F.lit(" <"), mm_type, F.lit("> tokens, found "),
                 act.cast("string")).alias("message"))).cast(prob_t)
    p_gpt = F.when(F.col("gpt_media_token"), F.struct(
        F.lit("gpt_media_token").alias("type"), F.lit(None).cast("string").alias("media_type"),
        F.lit(None).cast("bigint").alias("expected"), F.lit(None).cast("bigint").alias("actual"),
        F.lit(None).cast("array<string>").alias("files"),
        F.lit("GPT response contains media token (<image> or <video>)").alias("message"))).cast(prob_t)
    # a line that did not parse (e.g. a trailing comma) is a problem record
    p_parse = F.when(F.col(v).isNull(), F.struct(
        F.lit("parse_error").alias("type"), F.lit(None).cast("string").alias("media_type"),
        F.lit(None).cast("bigint").alias("expected"), F.lit(None).cast("bigint").alias("actual"),
        F.lit(None).cast("array<string>").alias("files"),
        F.lit("Record is not valid JSON").alias("message"))).cast(prob_t)
    probs = F.array_compact(F.array(p_parse, p_missing, p_mismatch, p_gpt))
    return x.withColumns({
        "mismatch_type": mm_type, "expected": exp, "actual": act, "validation_problems": probs,
        "status": F.when(F.size(probs) == 0, "valid").otherwise("problem")})


def totals(mt: Column) -> dict[str, Column]:
    """The counts of the summary as aggregates over checked records; ``mt``:
    their media type."""
    count = lambda c: F.count_if(c).cast("bigint")
    return {"total_entries": F.count(F.lit(1)), "valid_entries": count(F.col("status") == "valid"),
            "image_only": count(mt == "image"), "video_only": count(mt == "video"), "mixed_media": count(mt == "mixed"),
            "missing_media": count(F.size(F.coalesce("missing_files", F.array())) > 0),
            "token_mismatches": count(F.col("mismatch_type").isNotNull()), "gpt_media_tokens": count("gpt_media_token")}


def summary(checked: DataFrame, key: str, sample: int = 5) -> DataFrame:
    """Totals, valid share, media-type buckets, problem counts and the
    first ``sample`` missing paths in record order (a top-k)."""
    ensure_checkpoint_dir(checked.sparkSession)
    # the checks run once: totals and sample read this narrow table
    checked = checked.select(key, "status", "missing_files", "mismatch_type", "gpt_media_token",
                             media_type("images", "videos").alias("_mt")).checkpoint(eager=True)
    mt = F.col("_mt")
    first = (checked.filter(F.col("missing_files").isNotNull())
             .select(key, F.posexplode("missing_files").alias("k", "path"))
             .orderBy(key, "k").limit(sample)
             .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, "k", "path"))),
                                           lambda z: z["path"]), "\n")))
    out = checked.agg(*[c.alias(k) for k, c in totals(F.col("_mt")).items()])
    share = F.round(F.try_divide(F.col("valid_entries"), F.col("total_entries")), 6).alias("valid_share")
    return out.select("total_entries", "valid_entries", share, *out.columns[2:]).withColumn("sample_missing", first.scalar())


def split_lines(checked: DataFrame, v: str = "v") -> DataFrame:
    """(status, value): each record whole, as one JSON line; a problem record
    also has its ``validation_problems``.  A line that is not a JSON object
    is kept under ``record`` (its value) or ``line`` (its text)."""
    record, probs = F.to_json(v), F.to_json("validation_problems")
    line = F.col("line") if "line" in checked.columns else F.lit(None).cast("string")
    is_object = F.schema_of_variant(v).startswith("OBJECT")
    body = F.expr("substring(_r, 2, length(_r) - 2)")
    x = checked.withColumns({"_r": record, "_p": probs})
    as_object = F.concat(F.lit("{"), body, F.when(F.col("_r") == "{}", "").otherwise(","), F.lit('"validation_problems":'),
                         F.col("_p"), F.lit("}"))
    as_value = F.concat(F.lit('{"record":'), F.col("_r"), F.lit(',"validation_problems":'), F.col("_p"), F.lit("}"))
    as_line = F.to_json(F.struct(line.alias("line"), "validation_problems"))
    value = (F.when(F.col(v).isNull(), as_line).when(F.col("status") == "valid", F.col("_r"))
             .when(is_object, as_object).otherwise(as_value))
    return x.select("status", value.alias("value"))


def write_split(checked: DataFrame, path: str, v: str = "v") -> dict:
    """Valid and problem records as JSON lines, one folder per status.
    Returns the totals of the summary, counted on the records as they are
    written."""
    seen = Observation()
    observed = checked.observe(seen, *[c.alias(k) for k, c in totals(media_type("images", "videos")).items()])
    split_lines(observed, v).write.mode("overwrite").partitionBy("status").text(path)
    return seen.get
