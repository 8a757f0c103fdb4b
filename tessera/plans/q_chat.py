"""Registered queries: annotation reading, conversation building and
rendering (C2-C18), dataset registry (A3, A13)."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..operators import chat as C
from ..session import scratch_path
from ..sources import files as SRC
from ..sources.registry import Dataset, Registry
from . import annotations as AN
from . import fixtures as FX
from .registry import loader, query
from .sqlfrag import lit, word_count, words

W = FX.with_ctes
CANON_CONTENT = ("CASE WHEN form = 'from_value' THEN flat "
                 "ELSE (CASE WHEN has_img THEN '<image>' ELSE '' END) || seg_text END")


def _parsed(t, lines=AN.mixed_lines):
    x = lines(t).withColumn("v", F.parse_json("line"))
    cols = C.canonical_from_variant("v")
    return x.select("conv_id", "v", *[c.alias(n) for n, c in cols.items()]).withColumn("id", F.col("conv_id"))


# ---------------------------------------------------------------- A3 C3
@query("read_annotations", W(FX.TURNS_SQL) + """
SELECT CASE WHEN NOT (""" + AN.BARE + """) THEN conv_id END AS id, CAST(count(*) AS BIGINT) AS n_turns,
       CAST(count_if(has_img) AS BIGINT) AS n_images,
       CAST(CASE WHEN any_value(form) = 'from_value' THEN count_if(has_vid) ELSE 0 END AS BIGINT) AS n_videos
FROM turns GROUP BY conv_id""")
def read_annotations(spark, d):
    """Write the annotation JSONL, read it back through the VARIANT reader
    (bare lists among the lines have no id)."""
    path = scratch_path(spark, "annotations") + ".jsonl"
    SRC.write_jsonl(AN.mixed_lines(loader(spark, d)), "line", path)
    r = SRC.read_annotations(spark, path)
    return r.select(F.col("id").cast("bigint"), F.size("turns").cast("bigint").alias("n_turns"),
                    F.size("images").cast("bigint").alias("n_images"),
                    F.size("videos").cast("bigint").alias("n_videos"))


# ---------------------------------------------------------------- C2 C4 C5
@query("harmonize_roles", W(FX.TURNS_SQL) + """
SELECT conv_id AS id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS turn_idx,
       role, form FROM turns""")
def harmonize_roles(spark, d):
    p = _parsed(loader(spark, d))
    x = p.select("id", F.posexplode("turns").alias("turn_idx", "t"))
    return x.select("id", F.col("turn_idx").cast("bigint"), F.col("t.role").alias("role"),
                    F.when(F.col("t.from_value"), "from_value").otherwise("role_content").alias("form"))


@query("flatten_content", W(FX.TURNS_SQL) + """
SELECT conv_id AS id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS turn_idx,
       (CASE WHEN has_img THEN '<image>' ELSE '' END) || seg_text AS content
FROM turns WHERE form = 'role_content'""")
def flatten_content(spark, d):
    p = _parsed(loader(spark, d))
    x = p.select("id", F.posexplode("turns").alias("turn_idx", "t")).filter(~F.col("t.from_value"))
    return x.select("id", F.col("turn_idx").cast("bigint"), F.col("t.content").alias("content"))


@query("promote_media", W(FX.TURNS_SQL) + """
SELECT conv_id AS id, CAST(count_if(has_img) AS BIGINT) AS n_images,
       string_agg(CASE WHEN has_img THEN image_file END, ',' ORDER BY turn) AS images
FROM turns WHERE form = 'role_content' GROUP BY conv_id""")
def promote_media(spark, d):
    # role/content records (their turns carry no from/value keys)
    p = _parsed(loader(spark, d)).filter(~F.exists("turns", lambda t: t["from_value"]))
    return p.select("id", F.size("images").cast("bigint").alias("n_images"),
                    F.nullif(F.array_join("images", ","), F.lit("")).alias("images"))


# ---------------------------------------------------------------- C6 C7 C8 C9 C10
@query("conversation_lists", """
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, string_agg(role, '>' ORDER BY turn) AS roles,
       CAST(sum(length(text)) AS BIGINT) AS n_chars
FROM conversations GROUP BY conv_id""")
def conversation_lists(spark, d):
    g = C.group_turns(loader(spark, d)("conversations"), "conv_id", "turn", "role", "text")
    return g.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"),
                    F.array_join(F.transform("turns", lambda t: t["role"]), ">").alias("roles"),
                    F.aggregate("turns", F.lit(0).cast("bigint"),
                                lambda a, t: a + F.length(t["content"])).alias("n_chars"))


KEPT_SQL = """, ft AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM turns),
kept AS (SELECT * FROM ft WHERE NOT (rn = 1 AND form = 'from_value' AND role = 'assistant'))"""


@query("drop_leading_turn", W(FX.TURNS_SQL + KEPT_SQL) + """
SELECT c.conv_id AS id, CAST(count(k.turn) AS BIGINT) AS n_turns, arg_min(k.role, k.turn) AS first_role
FROM (SELECT DISTINCT conv_id FROM turns) c LEFT JOIN kept k ON k.conv_id = c.conv_id GROUP BY c.conv_id""")
def drop_leading_turn(spark, d):
    p = _parsed(loader(spark, d))
    kept = C.drop_leading_nonuser("turns", F.col("turns")[0]["from_value"])
    return p.select("id", F.size(kept).cast("bigint").alias("n_turns"), F.get(kept, 0)["role"].alias("first_role"))


@query("chat_render", W(FX.TURNS_SQL + KEPT_SQL) + f"""
SELECT c.conv_id AS id,
       {lit(K.IM_START + "system" + chr(10) + K.DEFAULT_SYSTEM + K.IM_END + chr(10))}
       || coalesce(string_agg('<|im_start|>' || role || chr(10) || ({CANON_CONTENT}) || '<|im_end|>' || chr(10),
                              '' ORDER BY turn), '') AS rendered
FROM (SELECT DISTINCT conv_id FROM turns) c LEFT JOIN kept k ON k.conv_id = c.conv_id GROUP BY c.conv_id""")
def chat_render(spark, d):
    p = _parsed(loader(spark, d))
    kept = C.drop_leading_nonuser("turns", F.col("turns")[0]["from_value"])
    return p.select("id", C.render_chat(kept).alias("rendered"))


@query("inference_prompt", W(FX.PROMPTS_SQL) + f"""
SELECT id, {lit(K.IM_START + "system" + chr(10) + K.INFERENCE_SYSTEM_PROMPT + K.IM_END + chr(10))}
  || '<|im_start|>user' || chr(10) || array_to_string({words('prompt')}, ' ')
  || '<|vision_start|><|image_pad|><|vision_end|><|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)
  AS text
FROM prompts""")
def inference_prompt(spark, d):
    p = FX.prompts(loader(spark, d))
    return p.select("id", C.inference_prompt(T.normalize_ws("prompt")).alias("text"))


# ---------------------------------------------------------------- C11 C12
@query("expand_visual", W(FX.TURNS_SQL, FX.MEDIA_GRID_SQL) + """,
grid_k AS (SELECT conv_id, kind, CAST(row_number() OVER (PARTITION BY conv_id, kind ORDER BY turn) - 1 AS BIGINT) AS k,
                  CAST(gt * gh * gw // 4 AS BIGINT) AS n FROM media_grid),
stags AS (SELECT conv_id, CASE WHEN bool_or(kind = 'image') THEN '<image>' ELSE '<video>' END AS stag
          FROM media_grid GROUP BY conv_id),
pieces AS (
  SELECT conv_id, turn, stag, unnest(parts) AS piece, generate_subscripts(parts, 1) AS piece_no, len(parts) AS n_parts
  FROM (SELECT t.conv_id, t.turn, coalesce(s.stag, '<image>') AS stag,
               string_split(t.flat, coalesce(s.stag, '<image>')) AS parts
        FROM turns t LEFT JOIN stags s ON s.conv_id = t.conv_id WHERE t.role = 'user')),
tagged AS (
  SELECT *, piece_no < n_parts AS has_tag, CASE stag WHEN '<image>' THEN 'image' ELSE 'video' END AS kind,
         sum(CASE WHEN piece_no < n_parts THEN 1 ELSE 0 END)
           OVER (PARTITION BY conv_id ORDER BY turn, piece_no ROWS UNBOUNDED PRECEDING) - 1 AS tag_index
  FROM pieces),
joined AS (
  SELECT t.*, piece || CASE WHEN has_tag THEN
           CASE WHEN g.n IS NULL THEN t.stag
                ELSE '<|vision_start|>' || repeat(CASE t.kind WHEN 'image' THEN '<|image_pad|>' ELSE '<|video_pad|>' END,
                                                  g.n) || '<|vision_end|>' END
         ELSE '' END AS piece_out,
         bool_or(has_tag AND g.n IS NULL) OVER (PARTITION BY t.conv_id) AS missing
  FROM tagged t LEFT JOIN grid_k g ON g.conv_id = t.conv_id AND g.kind = t.kind AND g.k = t.tag_index AND t.has_tag)
SELECT conv_id, turn, CASE WHEN any_value(missing) THEN 'missing_grid' ELSE 'ok' END AS status,
       string_agg(piece_out, '' ORDER BY piece_no) AS content
FROM joined GROUP BY conv_id, turn""")
def expand_visual(spark, d):
    """Tags of the sample's visual kind in user turns -> vision block with
    as many pads as its grid has merged patches; tags index the sample's
    files of that kind in order; the other kind's tags stay text."""
    from .q_tokens import grid_k
    tr = FX.turns(loader(spark, d))
    return C.expand_samples(tr, grid_k(tr))


@query("vision_ids", W(FX.TURNS_SQL) + """,
pieces AS (
  SELECT conv_id, turn, unnest(parts) AS piece, generate_subscripts(parts, 1) AS piece_no, tags
  FROM (SELECT conv_id, turn, regexp_split_to_array(flat, '<image>|<video>') AS parts,
               regexp_extract_all(flat, '<image>|<video>') AS tags FROM turns WHERE role = 'user')),
tagged AS (SELECT *, CASE WHEN piece_no <= len(tags) THEN tags[piece_no] END AS tag FROM pieces),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, tag ORDER BY turn, piece_no) AS k FROM tagged)
SELECT conv_id, turn, string_agg(piece || CASE
    WHEN tag = '<image>' THEN 'Picture ' || k || ': <|vision_start|><|image_pad|><|vision_end|>'
    WHEN tag = '<video>' THEN 'Video ' || k || ': <|vision_start|><|video_pad|><|vision_end|>'
    ELSE '' END, '' ORDER BY piece_no) AS content
FROM numbered GROUP BY conv_id, turn""")
def vision_ids(spark, d):
    """Vision-id labels: 'Picture k: ' / 'Video k: ' before each block,
    counted per kind over the record."""
    users = FX.turns(loader(spark, d)).filter(F.col("role") == "user").select("conv_id", "turn", "role", "flat")
    return C.replace_tags(users, "conv_id", "turn", "flat", with_ids=True)


# ---------------------------------------------------------------- C14 C15
def _typed_segments(t):
    r = AN._records(t)
    x = r.select("conv_id", F.explode("items").alias("it"))
    x = x.select("conv_id", F.col("it.turn").alias("turn"), F.posexplode("it.rc.content").alias("seg_no", "s"))
    return x


@query("vision_elements", W(FX.TURNS_SQL) + """
SELECT conv_id, turn, CAST(0 AS BIGINT) AS seg_no, 'image' AS kind, image_file AS ref FROM turns WHERE has_img
UNION ALL
SELECT conv_id, turn, CAST(CASE WHEN has_img THEN 2 ELSE 1 END AS BIGINT), 'video', video_file
FROM turns WHERE has_vid""")
def vision_elements(spark, d):
    """Content elements carrying image, image_url or video (by key or type);
    string content and other types are skipped."""
    s = _typed_segments(loader(spark, d))
    v = C.vision_element_columns(F.col("s"))
    return s.filter(v["is_vision"]).select("conv_id", "turn", F.col("seg_no").cast("bigint"),
                                           v["kind"].alias("kind"), v["ref"].alias("ref"))


VIDEO_FPS_SQL = """vmeta AS (
  SELECT conv_id, turn, video_file, CAST(30 + (conv_id * 7919 + turn * 104729) % 1800 AS BIGINT) AS total,
         CASE (conv_id + turn) % 4 WHEN 0 THEN 24.0 WHEN 1 THEN 30.0 WHEN 2 THEN 29.97 ELSE 25.0 END::DOUBLE AS vfps
  FROM turns WHERE has_vid),
vcount AS (
  SELECT *, CAST(floor(least(least(greatest(total / vfps * 2.0, 4), CAST(floor(least(768, total) / 2) * 2 AS BIGINT)),
                             total) / 2) * 2 AS BIGINT) AS n FROM vmeta),
vfps AS (
  SELECT *, CASE WHEN n >= 2 AND n <= total THEN CAST(round(n / greatest(CAST(total AS DOUBLE), 1e-6) * vfps, 6)
                                                     AS VARCHAR) END AS sample_fps FROM vcount)"""


def video_metadata(segments):
    """Per video element: total frames and native fps (derived from the
    record key, standing in for the decoder's report)."""
    v = segments.filter(F.col("s.video").isNotNull())
    cid, tn = F.col("conv_id"), F.col("turn")
    k = (cid + tn) % 4
    return v.select("conv_id", "turn", "seg_no",
                    (30 + (cid * 7919 + tn * 104729) % 1800).cast("bigint").alias("total_frames"),
                    F.when(k == 0, 24.0).when(k == 1, 30.0).when(k == 2, 29.97).otherwise(25.0).alias("video_fps"))


@query("vision_partition", W(FX.TURNS_SQL, VIDEO_FPS_SQL) + """
SELECT t.conv_id, CAST(count_if(has_img) AS BIGINT) AS n_images, CAST(count_if(has_vid) AS BIGINT) AS n_videos,
       string_agg(CASE WHEN has_img THEN image_file END, ',' ORDER BY t.turn) AS images,
       string_agg(CASE WHEN has_vid THEN t.video_file END, ',' ORDER BY t.turn) AS videos,
       string_agg(CASE WHEN has_vid THEN coalesce(f.sample_fps, 'rejected') END, ',' ORDER BY t.turn) AS video_fps
FROM turns t LEFT JOIN vfps f ON f.conv_id = t.conv_id AND f.turn = t.turn GROUP BY t.conv_id""")
def vision_partition(spark, d):
    """Images and videos of a record in separate ordered lists (null when
    empty), and the sampled fps of each video (frame count by the default
    2 fps rule, n / frames * native fps) as the video kwargs list."""
    from ..operators import video as VO
    s = _typed_segments(loader(spark, d))
    conv = FX.turns(loader(spark, d)).select("conv_id").distinct()
    meta = VO.frame_count(VO.frame_range(video_metadata(s)))
    fps = F.round(F.col("n_frames") / F.greatest(F.col("range_frames").cast("double"), F.lit(1e-6))
                  * F.col("video_fps"), 6)
    vf = meta.select("conv_id", "turn", "seg_no",
                     F.coalesce(fps.cast("string"), F.lit("rejected")).alias("sample_fps"))
    s = s.join(vf, ["conv_id", "turn", "seg_no"], "left")
    g = conv.join(C.partition_vision(s), "conv_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return g.select("conv_id", zero("n_images"), zero("n_videos"), "images", "videos", "video_fps")


# ---------------------------------------------------------------- C16 C17 C18 A13
@query("length_estimate", W(FX.TURNS_SQL) + f"""
SELECT conv_id AS id, CAST(sum({word_count('flat')}) + CASE WHEN count_if(has_img) = 1 THEN 128 ELSE 0 END
                           AS BIGINT) AS length
FROM turns GROUP BY conv_id""")
def length_estimate(spark, d):
    """Words over turns + 128 when the record has an ``image`` key."""
    x = AN.validation_lines(loader(spark, d)).withColumn("v", F.parse_json("line"))
    return x.select(F.col("conv_id").alias("id"), C.length_estimate("v").alias("length"))


@query("modality_length", W(FX.TURNS_SQL) + f"""
SELECT conv_id AS id, CAST(CASE WHEN count_if(has_img) = 1 OR count_if(has_vid) = 1
                                THEN sum({word_count('flat')}) ELSE -sum({word_count('flat')}) END AS BIGINT) AS length
FROM turns GROUP BY conv_id""")
def modality_length(spark, d):
    """Words over turns, negative when the record has no image/video key."""
    x = AN.validation_lines(loader(spark, d)).withColumn("v", F.parse_json("line"))
    return x.select(F.col("conv_id").alias("id"), C.modality_length("v").alias("length"))


def registry(d: str) -> Registry:
    """Two datasets over the driver tables: chat records from conversations
    (with a precomputed ``num_tokens``) and training conversations built
    from prompts (without)."""
    def chat(spark):
        c = loader(spark, d)("conversations")
        return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"),
                                        F.sum(T.word_count("text")).cast("bigint").alias("num_tokens")) \
            .withColumnRenamed("conv_id", "id")

    def prompts(spark):
        from ..operators import text as X
        p = X.min_token_filter(FX.prompts(loader(spark, d)), out=None)
        return p.select("id", F.lit(3).cast("bigint").alias("n_turns"))

    return Registry([Dataset("chat", chat, "media/chat"), Dataset("prompts", prompts, "media/prompts")])


UNION_SQL = W(FX.PROMPTS_SQL) + f""",
chat AS (SELECT 'chat' AS dataset, conv_id AS id, 'media/chat' AS data_path, 1.0::DOUBLE AS sampling_rate,
                CAST(count(*) AS BIGINT) AS n_turns, CAST(sum({word_count('text')}) AS BIGINT) AS num_tokens
         FROM conversations GROUP BY conv_id),
pr AS (SELECT id, row_number() OVER (ORDER BY md5('0:' || CAST(id AS VARCHAR)), id) - 1 AS pos,
              count(*) OVER () AS n FROM prompts WHERE {word_count('prompt')} >= 55),
prs AS (SELECT 'prompts' AS dataset, id, 'media/prompts' AS data_path, 0.5::DOUBLE AS sampling_rate,
               CAST(3 AS BIGINT) AS n_turns, CAST(NULL AS BIGINT) AS num_tokens
        FROM pr WHERE pos < floor(n * CAST(0.5 AS DOUBLE))),
u AS (SELECT * FROM chat UNION ALL SELECT * FROM prs)
"""


@query("dataset_union", UNION_SQL + "SELECT dataset, id, data_path, sampling_rate, n_turns FROM u")
def dataset_union(spark, d):
    u = registry(d).load(spark, ["chat", "prompts%50"])
    return u.select("dataset", "id", "data_path", "sampling_rate", "n_turns")


@query("precomputed_length", UNION_SQL + "SELECT dataset, id, coalesce(num_tokens, 1) AS length FROM u")
def precomputed_length(spark, d):
    u = registry(d).load(spark, ["chat", "prompts%50"])
    return C.precomputed_length(u).select("dataset", "id", "length")
