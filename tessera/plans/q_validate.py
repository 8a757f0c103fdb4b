"""Registered queries: annotation validation (D1-D7, A5, A6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import validate as V
from . import annotations as AN
from . import fixtures as FX
from .registry import loader, query

W = FX.with_ctes
ROOT = FX.MEDIA_ROOT


def checked(spark, d):
    t = loader(spark, d)
    x = AN.validation_lines(t).select(F.col("conv_id").alias("id"), F.parse_json("line").alias("v"))
    return V.problems(V.prepare(x), "id", FX.listing(t), ROOT)


VREC_SQL = f"""vrec AS (
  SELECT conv_id AS id,
         coalesce(list(image_file ORDER BY turn) FILTER (WHERE has_img), []) AS images,
         coalesce(list(video_file ORDER BY turn) FILTER (WHERE has_vid), []) AS videos,
         CAST(count_if(has_img) AS BIGINT) AS n_img, CAST(count_if(has_vid) AS BIGINT) AS n_vid,
         CAST(sum(CASE WHEN role = 'user' THEN (length(flat) - length(replace(flat, '<image>', ''))) // 7
                  ELSE 0 END) AS BIGINT) AS image_tags,
         CAST(sum(CASE WHEN role = 'user' THEN (length(flat) - length(replace(flat, '<video>', ''))) // 7
                  ELSE 0 END) AS BIGINT) AS video_tags,
         bool_or(role = 'assistant' AND (contains(flat, '<image>') OR contains(flat, '<video>'))) AS gpt_media_token
  FROM turns GROUP BY conv_id),
mpaths AS (
  SELECT conv_id AS id, '{ROOT}/' || image_file AS path, 0 AS ko, turn FROM turns WHERE has_img
  UNION ALL SELECT conv_id, '{ROOT}/' || video_file, 1, turn FROM turns WHERE has_vid),
missing AS (
  SELECT m.id, CAST(count(*) AS BIGINT) AS n_missing, string_agg(m.path, chr(10) ORDER BY ko, turn) AS missing_files
  FROM mpaths m LEFT JOIN (SELECT DISTINCT path FROM listing) l ON l.path = m.path
  WHERE l.path IS NULL GROUP BY m.id),
chk AS (
  SELECT v.*, coalesce(ms.n_missing, 0) AS n_missing, ms.missing_files,
         CASE WHEN image_tags <> n_img THEN 'image' WHEN video_tags <> n_vid THEN 'video' END AS mismatch_type,
         CASE WHEN image_tags <> n_img THEN n_img WHEN video_tags <> n_vid THEN n_vid END AS expected,
         CASE WHEN image_tags <> n_img THEN image_tags WHEN video_tags <> n_vid THEN video_tags END AS actual
  FROM vrec v LEFT JOIN missing ms ON ms.id = v.id),
chk2 AS (
  SELECT *, concat_ws(',', CASE WHEN n_missing > 0 THEN 'missing_files' END,
                           CASE WHEN mismatch_type IS NOT NULL THEN 'token_mismatch' END,
                           CASE WHEN gpt_media_token THEN 'gpt_media_token' END) AS problem_types
  FROM chk)"""
BASE = W(FX.TURNS_SQL, FX.LISTING_SQL, VREC_SQL)


@query("media_fields", BASE + """
SELECT id, n_img AS n_images, n_vid AS n_videos, array_to_string(images, ',') AS images,
       array_to_string(videos, ',') AS videos FROM vrec""")
def media_fields(spark, d):
    t = loader(spark, d)
    x = V.prepare(AN.validation_lines(t).select(F.col("conv_id").alias("id"), F.parse_json("line").alias("v")))
    return x.select("id", F.size("images").cast("bigint").alias("n_images"),
                    F.size("videos").cast("bigint").alias("n_videos"),
                    F.array_join("images", ",").alias("images"), F.array_join("videos", ",").alias("videos"))


@query("media_type_stats", BASE + """
SELECT CAST(count_if(n_img > 0 AND n_vid = 0) AS BIGINT) AS image_only,
       CAST(count_if(n_vid > 0 AND n_img = 0) AS BIGINT) AS video_only,
       CAST(count_if(n_img > 0 AND n_vid > 0) AS BIGINT) AS mixed_media FROM vrec""")
def media_type_stats(spark, d):
    t = loader(spark, d)
    x = V.prepare(AN.validation_lines(t).select(F.col("conv_id").alias("id"), F.parse_json("line").alias("v")))
    mt = V.media_type("images", "videos")
    return x.agg(F.count_if(mt == "image").cast("bigint").alias("image_only"),
                 F.count_if(mt == "video").cast("bigint").alias("video_only"),
                 F.count_if(mt == "mixed").cast("bigint").alias("mixed_media"))


@query("missing_media", BASE + "SELECT id, n_missing, missing_files FROM missing")
def missing_media(spark, d):
    t = loader(spark, d)
    x = V.prepare(AN.validation_lines(t).select(F.col("conv_id").alias("id"), F.parse_json("line").alias("v")))
    m = V.missing_media(x, "id", FX.listing(t), ROOT)
    return m.select("id", F.size("missing_files").cast("bigint").alias("n_missing"),
                    F.array_join("missing_files", "\n").alias("missing_files"))


@query("missing_media_filtered", BASE + "SELECT id, n_missing, missing_files FROM missing")
def missing_media_filtered(spark, d):
    """The same behind a Bloom filter of the listing."""
    t = loader(spark, d)
    x = V.prepare(AN.validation_lines(t).select(F.col("conv_id").alias("id"), F.parse_json("line").alias("v")))
    m = V.missing_media(x, "id", FX.listing(t), ROOT, by_filter=True)
    return m.select("id", F.size("missing_files").cast("bigint").alias("n_missing"),
                    F.array_join("missing_files", "\n").alias("missing_files"))


@query("token_mismatch", BASE + """
SELECT id, mismatch_type AS media_type, expected, actual FROM chk WHERE mismatch_type IS NOT NULL""")
def token_mismatch(spark, d):
    c = checked(spark, d).filter(F.col("mismatch_type").isNotNull())
    return c.select("id", F.col("mismatch_type").alias("media_type"), "expected", "actual")


@query("answer_media_tag", BASE + "SELECT id FROM vrec WHERE gpt_media_token")
def answer_media_tag(spark, d):
    t = loader(spark, d)
    x = V.prepare(AN.validation_lines(t).select(F.col("conv_id").alias("id"), F.parse_json("line").alias("v")))
    return x.filter("gpt_media_token").select("id")


@query("validate_split", BASE + """
SELECT id, CASE WHEN problem_types = '' THEN 'valid' ELSE 'problem' END AS status, problem_types FROM chk2""")
def validate_split(spark, d):
    c = checked(spark, d)
    return c.select("id", "status", F.array_join(F.transform("validation_problems", lambda p: p["type"]), ",")
                    .alias("problem_types"))


@query("validation_summary", BASE + """,
first5 AS (SELECT string_agg(path, chr(10) ORDER BY id, ko, turn) AS sample_missing FROM (
  SELECT m.* FROM mpaths m LEFT JOIN (SELECT DISTINCT path FROM listing) l ON l.path = m.path
  WHERE l.path IS NULL ORDER BY id, ko, turn LIMIT 5))
SELECT CAST(count(*) AS BIGINT) AS total_entries,
       CAST(count_if(problem_types = '') AS BIGINT) AS valid_entries,
       round(count_if(problem_types = '') / count(*), 6) AS valid_share,
       CAST(count_if(n_img > 0 AND n_vid = 0) AS BIGINT) AS image_only,
       CAST(count_if(n_vid > 0 AND n_img = 0) AS BIGINT) AS video_only,
       CAST(count_if(n_img > 0 AND n_vid > 0) AS BIGINT) AS mixed_media,
       CAST(count_if(n_missing > 0) AS BIGINT) AS missing_media,
       CAST(count_if(mismatch_type IS NOT NULL) AS BIGINT) AS token_mismatches,
       CAST(count_if(gpt_media_token) AS BIGINT) AS gpt_media_tokens,
       (SELECT sample_missing FROM first5) AS sample_missing
FROM chk2""")
def validation_summary(spark, d):
    return V.summary(checked(spark, d), "id")


_TWICE = "CASE WHEN id % 4 = 1 THEN 2 ELSE 1 END"


@query("validate_every_record", BASE + f""",
first5 AS (SELECT string_agg(path, chr(10) ORDER BY id, copy, ko, turn) AS sample_missing FROM (
  SELECT m.*, unnest(range({_TWICE.replace("id", "m.id")})) AS copy
  FROM mpaths m LEFT JOIN (SELECT DISTINCT path FROM listing) l ON l.path = m.path
  WHERE l.path IS NULL ORDER BY id, copy, ko, turn LIMIT 5)),
n AS (SELECT *, {_TWICE} AS c, problem_types = '' AS valid FROM chk2)
SELECT CAST(sum(c) AS BIGINT) AS total_entries, CAST(sum(c) FILTER (WHERE valid) AS BIGINT) AS valid_entries,
       round(sum(c) FILTER (WHERE valid) / sum(c), 6) AS valid_share,
       CAST(coalesce(sum(c) FILTER (WHERE n_img > 0 AND n_vid = 0), 0) AS BIGINT) AS image_only,
       CAST(coalesce(sum(c) FILTER (WHERE n_vid > 0 AND n_img = 0), 0) AS BIGINT) AS video_only,
       CAST(coalesce(sum(c) FILTER (WHERE n_img > 0 AND n_vid > 0), 0) AS BIGINT) AS mixed_media,
       CAST(coalesce(sum(c) FILTER (WHERE n_missing > 0), 0) AS BIGINT) AS missing_media,
       CAST(coalesce(sum(c) FILTER (WHERE mismatch_type IS NOT NULL), 0) AS BIGINT) AS token_mismatches,
       CAST(coalesce(sum(c) FILTER (WHERE gpt_media_token), 0) AS BIGINT) AS gpt_media_tokens,
       (SELECT sample_missing FROM first5) AS sample_missing
FROM n""")
def validate_every_record(spark, d):
    """The validator over a file of lines without ids, some of them repeated:
    every line counts, and the sample of missing paths follows the file."""
    from .. import api
    from ..session import scratch_path
    from ..sources import files as SRC
    t = loader(spark, d)
    path = scratch_path(spark, "every-record") + ".jsonl"
    SRC.write_jsonl(AN.keyless_lines(t), "line", path)
    return api.validate_data(spark, path, ROOT, listing=FX.listing(t))[1]


@query("validation_totals_written", BASE + """
SELECT CAST(count(*) AS BIGINT) AS total_entries, CAST(count_if(problem_types = '') AS BIGINT) AS valid_entries,
       CAST(count_if(n_img > 0 AND n_vid = 0) AS BIGINT) AS image_only, CAST(count_if(n_vid > 0 AND n_img = 0) AS BIGINT) AS video_only,
       CAST(count_if(n_img > 0 AND n_vid > 0) AS BIGINT) AS mixed_media, CAST(count_if(n_missing > 0) AS BIGINT) AS missing_media,
       CAST(count_if(mismatch_type IS NOT NULL) AS BIGINT) AS token_mismatches,
       CAST(count_if(gpt_media_token) AS BIGINT) AS gpt_media_tokens FROM chk2""")
def validation_totals_written(spark, d):
    """The totals that come with writing the valid and problem records."""
    from ..session import scratch_path
    got = V.write_split(checked(spark, d), scratch_path(spark, "validated"))
    return spark.createDataFrame([tuple(got.values())], ", ".join(f"{k} long" for k in got))
