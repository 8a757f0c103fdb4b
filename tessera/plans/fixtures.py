"""Derived input tables, built from the driver tables.

The reference works on a prompt CSV, chat annotation files and media
folders.  Those shapes are derived here from the driver's parquet tables
(documents, embeddings, conversations, labels, pages, benchmark, events).
Each derivation exists twice, as a DataFrame builder and as a DuckDB CTE,
and the two must stay identical: the SQL side is the oracle.

Derivation rules (arithmetic on ids, so the work grows with the tables):

* prompts: one per document; url from doc_id; width/height from doc_id.
* pair_scores: vector ``vec_id`` paired with ``vec_id + 1`` (image, text).
* responses: model answers built from documents and benchmark items, with
  the marker absent, present once, present twice or quoted.
* turns: conversation turns with media placeholders placed by arithmetic
  on (conv_id, turn): an image before user text, a video after it, an
  extra unmatched image tag, a tag in an answer, an unknown segment type;
  the first turn of every sixth conversation is an answer.
* listing: media files known to exist, one set per labelled document.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V

Loader = Callable[[str], DataFrame]

MEDIA_ROOT = "media_root"


def _s(c: Column) -> Column:
    return c.cast("string")


# ---------------------------------------------------------------- prompts
def prompts(t: Loader) -> DataFrame:
    d = t("documents")
    return d.select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("prompt"),
        F.concat(F.lit("https://img.example.org/p/"), _s(F.col("doc_id")), F.lit(".jpg")).alias("url"),
        (F.lit(10) + (F.col("doc_id") * 7919) % 4000).cast("bigint").alias("width"),
        (F.lit(10) + (F.col("doc_id") * 104729) % 3000).cast("bigint").alias("height"),
        F.col("source").alias("source_site"),
    )


PROMPTS_SQL = """prompts AS (
  SELECT doc_id AS id, text AS prompt,
         'https://img.example.org/p/' || CAST(doc_id AS VARCHAR) || '.jpg' AS url,
         CAST(10 + (doc_id * 7919) % 4000 AS BIGINT) AS width,
         CAST(10 + (doc_id * 104729) % 3000 AS BIGINT) AS height,
         source AS source_site
  FROM documents)"""


def pair_scores(t: Loader) -> DataFrame:
    e = t("embeddings")
    a = e.select("vec_id", F.col("embedding").alias("img"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("txt"))
    return a.join(b, "vec_id").select("vec_id", V.cosine("img", "txt").alias("similarity"))


PAIR_SCORES_SQL = """pair_scores AS (
  SELECT a.vec_id,
         list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])
           / (greatest(sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])), 1e-8)
              * greatest(sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 1e-8))
           AS similarity
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"""


def scored_prompts(t: Loader) -> DataFrame:
    """Every prompt with a similarity: prompts take the pairs in turn."""
    s = pair_scores(t).withColumnRenamed("vec_id", "_pair")
    n = t("embeddings").agg(F.count(F.lit(1)) - 1).scalar()
    return prompts(t).withColumn("_pair", F.col("id") % n).join(s, "_pair").drop("_pair")


SCORED_SQL = PROMPTS_SQL + ",\n" + PAIR_SCORES_SQL + """,
scored AS (SELECT p.*, s.similarity FROM prompts p JOIN pair_scores s ON s.vec_id = p.id % (SELECT count(*) - 1 FROM embeddings))"""


# ---------------------------------------------------------------- responses
def responses(t: Loader) -> DataFrame:
    d = t("documents").select("doc_id", "text")
    b = t("benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("btext"))
    body = F.coalesce(F.col("btext"), F.col("text"))
    k = F.col("doc_id") % 4
    resp = (F.when(k == 0, body)
            .when(k == 1, F.concat(F.lit('Here is the result. Enhanced Prompt: "'), body, F.lit('"')))
            .when(k == 2, F.concat(F.lit("Enhanced Prompt: draft\nEnhanced Prompt:  "), body, F.lit("  ")))
            .otherwise(F.concat(F.lit('Enhanced Prompt: \n "'), body, F.lit('" '))))
    return d.join(b, "doc_id", "left").select(F.col("doc_id").alias("id"), resp.alias("response"))


RESPONSES_SQL = """responses AS (
  SELECT d.doc_id AS id,
         CASE d.doc_id % 4
           WHEN 0 THEN coalesce(b.text, d.text)
           WHEN 1 THEN 'Here is the result. Enhanced Prompt: "' || coalesce(b.text, d.text) || '"'
           WHEN 2 THEN 'Enhanced Prompt: draft' || chr(10) || 'Enhanced Prompt:  ' || coalesce(b.text, d.text) || '  '
           ELSE 'Enhanced Prompt: ' || chr(10) || ' "' || coalesce(b.text, d.text) || '" '
         END AS response
  FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id)"""


# ---------------------------------------------------------------- turns
def turns(t: Loader) -> DataFrame:
    cid, tn, role = F.col("conv_id"), F.col("turn"), F.col("role")
    # some conversations in the from/value form begin with an answer: there the first turn has that role
    c = t("conversations").withColumn(
        "role", F.when((cid % 6 == 4) & (tn == 0) & (role == "user"), F.lit("assistant")).otherwise(role))
    has_img = (role == "user") & ((cid + tn) % 3 == 0)
    has_vid = (role == "user") & ((cid + 2 * tn) % 7 == 0)
    extra = (role == "user") & ((3 * cid + tn) % 17 == 0)
    answer = (role == "assistant") & ((cid + tn) % 13 == 0)
    audio = (cid + tn) % 5 == 0
    seg_text = F.concat(F.col("text"), F.when(extra, F.lit("<image>")).otherwise(F.lit("")),
                        F.when(answer, F.lit(" <video>")).otherwise(F.lit("")))
    flat = F.concat(F.when(has_img, F.lit("<image>\n")).otherwise(F.lit("")), seg_text,
                    F.when(has_vid, F.lit("<video>")).otherwise(F.lit("")))
    return c.select(
        "conv_id", "turn", "role", "text",
        has_img.alias("has_img"), has_vid.alias("has_vid"), extra.alias("extra_tag"),
        answer.alias("answer_tag"), audio.alias("has_audio"),
        F.concat(F.lit("media/img_"), _s(cid), F.lit("_"), _s(tn), F.lit(".jpg")).alias("image_file"),
        F.concat(F.lit("media/vid_"), _s(cid), F.lit("_"), _s(tn), F.lit(".mp4")).alias("video_file"),
        seg_text.alias("seg_text"), flat.alias("flat"),
        F.when(cid % 2 == 0, F.lit("from_value")).otherwise(F.lit("role_content")).alias("form"),
    )


TURNS_SQL = """turns AS (
  SELECT conv_id, turn, role, text, has_img, has_vid, extra_tag, answer_tag, has_audio,
         image_file, video_file, seg_text,
         CASE WHEN has_img THEN '<image>' || chr(10) ELSE '' END || seg_text
           || CASE WHEN has_vid THEN '<video>' ELSE '' END AS flat,
         form
  FROM (
    SELECT *, text || CASE WHEN extra_tag THEN '<image>' ELSE '' END
                   || CASE WHEN answer_tag THEN ' <video>' ELSE '' END AS seg_text
    FROM (
      SELECT conv_id, turn, role, text,
             (role = 'user' AND (conv_id + turn) % 3 = 0) AS has_img,
             (role = 'user' AND (conv_id + 2 * turn) % 7 = 0) AS has_vid,
             (role = 'user' AND (3 * conv_id + turn) % 17 = 0) AS extra_tag,
             (role = 'assistant' AND (conv_id + turn) % 13 = 0) AS answer_tag,
             ((conv_id + turn) % 5 = 0) AS has_audio,
             'media/img_' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) || '.jpg' AS image_file,
             'media/vid_' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) || '.mp4' AS video_file,
             CASE WHEN conv_id % 2 = 0 THEN 'from_value' ELSE 'role_content' END AS form
      FROM (SELECT conv_id, turn, text,
                   CASE WHEN conv_id % 6 = 4 AND turn = 0 AND role = 'user' THEN 'assistant' ELSE role END AS role
            FROM conversations) c) x) y)"""


def media_grid(tr: DataFrame) -> DataFrame:
    """Per media file: kind, ordinal k within its kind in the conversation
    (turn order), and the (t, h, w) patch grid with seconds per grid."""
    cid, tn = F.col("conv_id"), F.col("turn")
    img = tr.filter("has_img").select(
        "conv_id", "turn", F.lit("image").alias("kind"), F.col("image_file").alias("file"),
        F.lit(1).cast("bigint").alias("gt"),
        (2 * (1 + (cid + tn) % 4)).cast("bigint").alias("gh"),
        (2 * (1 + (3 * cid + tn) % 5)).cast("bigint").alias("gw"),
        F.lit(0.0).alias("sec"))
    vid = tr.filter("has_vid").select(
        "conv_id", "turn", F.lit("video").alias("kind"), F.col("video_file").alias("file"),
        (2 + (cid + tn) % 3).cast("bigint").alias("gt"),
        F.lit(4).cast("bigint").alias("gh"),
        (2 * (1 + (cid + tn) % 3)).cast("bigint").alias("gw"),
        F.when(cid % 3 == 0, 1.0).when(cid % 3 == 1, 0.5).otherwise(0.25).alias("sec"))
    return img.unionByName(vid)


MEDIA_GRID_SQL = """media_grid AS (
  SELECT conv_id, turn, 'image' AS kind, image_file AS file, CAST(1 AS BIGINT) AS gt,
         CAST(2 * (1 + (conv_id + turn) % 4) AS BIGINT) AS gh,
         CAST(2 * (1 + (3 * conv_id + turn) % 5) AS BIGINT) AS gw, 0.0::DOUBLE AS sec
  FROM turns WHERE has_img
  UNION ALL
  SELECT conv_id, turn, 'video', video_file, CAST(2 + (conv_id + turn) % 3 AS BIGINT),
         CAST(4 AS BIGINT), CAST(2 * (1 + (conv_id + turn) % 3) AS BIGINT),
         CASE conv_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.25 END::DOUBLE
  FROM turns WHERE has_vid)"""


def listing(t: Loader) -> DataFrame:
    """Media files that exist: image and video files of turns 0-7 for every
    document labelled quality = 1."""
    lab = t("labels").filter(F.col("quality") == 1).select(F.col("doc_id").alias("cid"))
    k = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")
    ks = lab.select("cid", k)
    files = F.array(
        F.concat(F.lit("media/img_"), _s(F.col("cid")), F.lit("_"), _s(F.col("k")), F.lit(".jpg")),
        F.concat(F.lit("media/vid_"), _s(F.col("cid")), F.lit("_"), _s(F.col("k")), F.lit(".mp4")))
    return ks.select(F.explode(files).alias("file")).select(
        F.concat(F.lit(MEDIA_ROOT + "/"), F.col("file")).alias("path"))


LISTING_SQL = """listing AS (
  SELECT '""" + MEDIA_ROOT + """/' || f AS path FROM (
    SELECT unnest(['media/img_' || CAST(doc_id AS VARCHAR) || '_' || CAST(k AS VARCHAR) || '.jpg',
                   'media/vid_' || CAST(doc_id AS VARCHAR) || '_' || CAST(k AS VARCHAR) || '.mp4']) AS f
    FROM labels, range(0, 8) r(k) WHERE quality = 1) z)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
