"""Conversation building, harmonisation, rendering and per-record lengths.

Canonical record: ``turns ARRAY<STRUCT<role STRING, content STRING>>``
(plus ``images``/``videos`` arrays).  Every transformation is a Column
expression over the record's own arrays, so the work is per row and needs
no shuffle; grouping turns into records is one hash aggregation by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from .prefix import prefix_sums

SEGMENT = "struct<type:string,text:string,image:string,image_url:string,video:string>"
TURN = "struct<role:string,content:string>"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ------------------------------------------------------------------ C1
def _seg(typ: str, text=None, image=None) -> Column:
    return F.struct(F.lit(typ).alias("type"),
                    (text if text is not None else F.lit(None).cast("string")).alias("text"),
                    (image if image is not None else F.lit(None).cast("string")).alias("image"))


def training_conversation(url, prompt, truncated, system: str = K.TRAIN_SYSTEM_MESSAGE) -> Column:
    """system + user[image, original prompt] + assistant[enhanced prompt]."""
    return F.array(
        F.struct(F.lit("system").alias("role"), F.array(_seg("text", F.lit(system))).alias("content")),
        F.struct(F.lit("user").alias("role"), F.array(
            _seg("image", image=_c(url)),
            _seg("text", F.concat(F.lit("Original Prompt: '"), _c(prompt), F.lit("'")))).alias("content")),
        F.struct(F.lit("assistant").alias("role"), F.array(
            _seg("text", F.concat(F.lit("Enhanced Prompt: '"), _c(truncated), F.lit("'")))).alias("content")),
    )


def to_jsonl(col) -> Column:
    """One JSON document per row (a top-level array stays an array);
    absent segment fields are omitted, as the reference writes them."""
    return F.to_json(_c(col))


# ------------------------------------------------------------------ C2-C5
def map_role(role) -> Column:
    r = _c(role)
    out = r
    for src, dst in K.ROLE_MAP.items():
        out = F.when(r == src, F.lit(dst)).otherwise(out)
    return out


def vision_element_columns(s) -> dict[str, Column]:
    """For one content element: whether it is a vision element (an image,
    image_url or video key, or such a type), its kind, its reference, and
    ``no_media_key`` when it has the type but none of the keys (an error
    in the reference)."""
    has_img = s["image"].isNotNull() | s["image_url"].isNotNull()
    has_vid = s["video"].isNotNull()
    is_vis = has_img | has_vid | s["type"].isin("image", "image_url", "video")
    return {"is_vision": is_vis,
            "kind": F.when(has_img, "image").when(has_vid, "video"),
            "ref": F.coalesce(s["image"], s["image_url"], s["video"]),
            "status": F.when(is_vis & ~has_img & ~has_vid, "no_media_key").otherwise("ok")}


def flatten_segments(segs) -> Column:
    """Text kept, image -> <image>, joined with no separator; other types ignored."""
    keep = F.filter(_c(segs), lambda s: s["type"].isin("text", "image"))
    return F.array_join(F.transform(keep, lambda s: F.when(s["type"] == "text", F.coalesce(s["text"], F.lit("")))
                                    .otherwise(F.lit(K.IMAGE_TAG))), "")


def segment_images(segs) -> Column:
    return F.transform(F.filter(_c(segs), lambda s: s["type"] == "image"), lambda s: s["image"])


def _vkind(v: Column) -> Column:
    return F.schema_of_variant(v)


def canonical_from_variant(v) -> dict[str, Column]:
    """Columns of the canonical record from one parsed annotation.

    A bare list is a conversation (wrapped); turns use role/content or
    from/value; content is a string or a typed segment list (flattened,
    images promoted); media fields may be singular or plural, string or
    list.
    """
    v = _c(v)
    convs = F.coalesce(F.try_variant_get(v, "$", "array<variant>"),
                       F.try_variant_get(v, "$.conversations", "array<variant>"))

    def content_of(t):
        cv = F.try_variant_get(t, "$.content", "variant")
        segs = F.try_variant_get(t, "$.content", f"array<{SEGMENT}>")
        as_list = _vkind(cv).startswith("ARRAY")
        return F.when(as_list, flatten_segments(segs)).otherwise(
            F.coalesce(F.try_variant_get(t, "$.content", "string"), F.try_variant_get(t, "$.value", "string")))

    turns = F.transform(convs, lambda t: F.struct(
        map_role(F.coalesce(F.try_variant_get(t, "$.role", "string"),
                            F.try_variant_get(t, "$.from", "string"))).alias("role"),
        content_of(t).alias("content"),
        F.try_variant_get(t, "$.from", "string").isNotNull().alias("from_value")))
    promoted = F.flatten(F.transform(convs, lambda t: F.coalesce(
        segment_images(F.try_variant_get(t, "$.content", f"array<{SEGMENT}>")),
        F.array().cast("array<string>"))))

    def media(single: str, plural: str) -> Column:
        s = F.try_variant_get(v, f"$.{single}", "variant")
        p = F.try_variant_get(v, f"$.{plural}", "variant")
        x = F.when(s.isNotNull() & ~F.is_variant_null(s), s).otherwise(p)
        k = _vkind(x)
        return (F.when(k == "STRING", F.array(F.try_variant_get(x, "$", "string")))
                .when(k.startswith("ARRAY"), F.try_variant_get(x, "$", "array<string>"))
                .otherwise(F.array().cast("array<string>")))

    images = media("image", "images")
    return {
        "id": F.try_variant_get(v, "$.id", "string"),
        "turns": turns,
        "images": F.when(F.size(promoted) > 0, promoted).otherwise(images),
        "videos": media("video", "videos"),
    }


# ------------------------------------------------------------------ C6-C9
def group_turns(df: DataFrame, key: str, order: str, role: str = "role", content: str = "content",
                extra: tuple = ()) -> DataFrame:
    """Turns (one row each) -> one record per ``key`` with ordered turns."""
    s = F.struct(F.col(order).alias("_o"), F.col(role).alias("role"), F.col(content).alias("content"))
    return (df.groupBy(key, *extra)
            .agg(F.sort_array(F.collect_list(s)).alias("_t"))
            .withColumn("turns", F.transform("_t", lambda x: F.struct(x["role"].alias("role"),
                                                                      x["content"].alias("content"))))
            .drop("_t"))


def drop_leading_nonuser(turns, from_value) -> Column:
    """Drop a leading answer turn of a from/value record.

    The lookup table knows only ``human`` and ``gpt``: a leading ``gpt``
    turn maps to assistant (not user) and is dropped; any other leading
    key (``system``, ...) fails the lookup and the record is kept as is,
    as are role/content records."""
    t = _c(turns)
    return F.when(_c(from_value) & (F.size(t) > 0) & (t[0]["role"] == "assistant"),
                  F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0)))).otherwise(t)


def render_turn(role, content) -> Column:
    return F.concat(F.lit(K.IM_START), _c(role), F.lit("\n"), _c(content), F.lit(K.IM_END + "\n"))


def render_chat(turns, system: str | None = K.DEFAULT_SYSTEM, generation: bool = False) -> Column:
    """Chat template: ``<|im_start|>role\\ncontent<|im_end|>\\n`` per turn,
    default system turn first, optional generation suffix."""
    body = F.array_join(F.transform(_c(turns), lambda t: render_turn(t["role"], t["content"])), "")
    parts = []
    if system is not None:
        parts.append(F.lit(K.IM_START + "system\n" + system + K.IM_END + "\n"))
    parts.append(body)
    if generation:
        parts.append(F.lit(K.IM_START + "assistant\n"))
    return F.concat(*parts)


def inference_prompt(prompt, system: str = K.INFERENCE_SYSTEM_PROMPT) -> Column:
    """system + user[text, image] with the generation suffix, as the
    vision processor renders it (an image item becomes one vision block)."""
    user = F.concat(_c(prompt), F.lit(K.VISION_START + K.IMAGE_PAD + K.VISION_END))
    return F.concat(F.lit(K.IM_START + "system\n" + system + K.IM_END + "\n"),
                    render_turn(F.lit("user"), user), F.lit(K.IM_START + "assistant\n"))


# ------------------------------------------------------------------ C11-C12
def _count_of(values, x: str) -> Column:
    return F.size(F.filter(values, lambda v: v == x))


def tag_pieces(df: DataFrame, key: str, order: str, content: str, tags=(K.IMAGE_TAG, K.VIDEO_TAG),
               only_role: str | None = "user", role: str = "role", active: DataFrame | None = None) -> DataFrame:
    """Split each turn on media tags: one row per piece (text before the
    i-th tag, or the tail) with the tag that follows it, and the running
    index of that tag per kind over the whole record (turn order).

    The running index is a prefix count over the turns of the record, so a
    very long record is spread over many tasks; ``_before_rows`` counts the
    pieces before this one in the record.  The tags of a turn are counted in
    place, and the texts are dealt once and split after that.

    With ``active`` (key, _stag: the one tag of each record, the first of
    ``tags`` where it has none) only that tag splits the text; other tags stay
    literal text, as when a record is processed for one visual kind.
    """
    esc = lambda t: t.replace("<", r"\<").replace(">", r"\>")
    txt = F.col(content)
    split_here = F.col(role) == only_role if only_role is not None else F.lit(True)
    one = F.lit(1).cast("bigint")
    sums = {f"_before_{i}": F.when(split_here, T.count_occurrences(txt, t)).otherwise(0).cast("bigint") for i, t in enumerate(tags)}
    x = prefix_sums(df, [key], order, [], {**sums, "_before_turns": one}, group=active)
    before = [F.col(f"_before_{i}") for i in range(len(tags))]
    if active is None:
        pattern = "|".join(esc(t) for t in tags)
        parts = F.when(split_here, F.split(txt, pattern, -1)).otherwise(F.array(txt))
        found = F.when(split_here, F.regexp_extract_all(txt, F.lit("(" + pattern + ")"), 1)).otherwise(F.array().cast("array<string>"))
        turns = sum(before[1:], before[0])
    else:
        x = x.withColumn("_stag", F.coalesce("_stag", F.lit(tags[0])))
        parts = F.array(txt)
        turns = F.lit(0)
        for i, t in enumerate(tags):
            parts = F.when(split_here & (F.col("_stag") == t), F.split(txt, esc(t), -1)).otherwise(parts)
            turns = F.when(F.col("_stag") == t, before[i]).otherwise(turns)
        found = F.array_repeat(F.col("_stag"), F.size("_parts") - 1)
    x = x.withColumns({"_parts": parts, "_before_rows": turns + F.col("_before_turns")}).withColumn("_tags", found)
    x = x.select("*", F.posexplode("_parts").alias("_piece_no", "piece"), F.size("_parts").alias("n_pieces"))
    tag = F.get(F.col("_tags"), F.col("_piece_no"))
    idx = F.lit(None).cast("bigint")
    for i, t in enumerate(tags):
        here = _count_of(F.slice("_tags", 1, F.col("_piece_no")), t)
        idx = F.when(tag == t, before[i] + here).otherwise(idx)
    return x.withColumns({"tag": tag, "tag_index": idx.cast("bigint"),
                          "_before_rows": (F.col("_before_rows") + F.col("_piece_no")).cast("bigint")}).drop(
        "_parts", "_tags", "_before_turns", *[f"_before_{i}" for i in range(len(tags))])


def reassemble(pieces: DataFrame, key: str, order: str, piece: str, out: str, extra=()) -> DataFrame:
    s = F.struct(F.col("_piece_no").alias("n"), F.col(piece).alias("p"))
    return (pieces.groupBy(key, order, *extra)
            .agg(F.array_join(F.transform(F.sort_array(F.collect_list(s)), lambda z: z["p"]), "").alias(out)))


def vision_block(kind: str, n=None) -> Column:
    pad = K.IMAGE_PAD if kind == "image" else K.VIDEO_PAD
    mid = F.lit(pad) if n is None else F.repeat(F.lit(pad), _c(n).cast("int"))
    return F.concat(F.lit(K.VISION_START), mid, F.lit(K.VISION_END))


# ------------------------------------------------------------------ C16-C18
def value_words(v) -> Column:
    """Words over the ``value`` texts of a record's conversations."""
    convs = F.coalesce(F.try_variant_get(_c(v), "$.conversations", "array<variant>"), F.array().cast("array<variant>"))
    return F.aggregate(convs, F.lit(0).cast("bigint"),
                       lambda a, t: a + T.word_count(F.coalesce(F.try_variant_get(t, "$.value", "string"), F.lit(""))))


def length_estimate(v) -> Column:
    """Words over turns, plus 128 when the record has an ``image`` key."""
    has_image = F.try_variant_get(_c(v), "$.image", "variant").isNotNull()
    return (value_words(v) + F.when(has_image, 128).otherwise(0)).cast("bigint")


def modality_length(v) -> Column:
    """Words over turns, negative when the record has no image or video key."""
    media = (F.try_variant_get(_c(v), "$.image", "variant").isNotNull()
             | F.try_variant_get(_c(v), "$.video", "variant").isNotNull())
    n = value_words(v)
    return F.when(media, n).otherwise(-n).cast("bigint")


def replace_tags(df: DataFrame, key: str, order: str, content: str, out: str = "content",
                 with_ids: bool = False, extra: tuple = ()) -> DataFrame:
    """Each media tag in user turns -> one vision block; with ``with_ids``
    prefixed by 'Picture k: ' / 'Video k: ' counted per kind over the
    record (the documented add_vision_id option)."""
    p = tag_pieces(df, key, order, content)
    k = (F.col("tag_index") + 1).cast("string")
    img, vid = vision_block("image"), vision_block("video")
    if with_ids:
        img = F.concat(F.lit(K.PICTURE_LABEL.split("{}")[0]), k, F.lit(K.PICTURE_LABEL.split("{}")[1]), img)
        vid = F.concat(F.lit(K.VIDEO_LABEL.split("{}")[0]), k, F.lit(K.VIDEO_LABEL.split("{}")[1]), vid)
    lab = F.when(F.col("tag") == K.IMAGE_TAG, img).when(F.col("tag") == K.VIDEO_TAG, vid).otherwise(F.lit(""))
    return reassemble(p.withColumn("_piece_out", F.concat(F.col("piece"), lab)), key, order, "_piece_out", out,
                      extra=extra)


def expand_samples(turns: DataFrame, grid: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, turn, status, content): tags of the sample's visual kind in user
    turns become vision blocks with as many pads as the grid has merged
    patches.  Tags index the sample's files of that kind in order; the other
    kind's tags stay text; a tag without a grid marks the sample."""
    from .positions import sample_tags
    users = turns.filter(F.col("role") == "user").select(key, "turn", "role", "flat")
    pieces = tag_pieces(users, key, "turn", "flat", active=sample_tags(grid, key)).withColumn(
        "kind", F.when(F.col("tag") == K.IMAGE_TAG, "image").when(F.col("tag") == K.VIDEO_TAG, "video"))
    g = grid.select(key, "kind", F.col("k").alias("tag_index"),
                    (F.col("gt") * F.col("gh") * F.col("gw") / 4).cast("bigint").alias("n_pad"))
    j = pieces.join(g, [key, "kind", "tag_index"], "left")
    block = F.when(F.col("kind") == "image", vision_block("image", "n_pad")).otherwise(vision_block("video", "n_pad"))
    out = F.concat(F.col("piece"), F.when(F.col("tag").isNull(), F.lit("")).when(
        F.col("n_pad").isNull(), F.col("tag")).otherwise(block))
    miss = j.groupBy(key).agg(F.max((F.col("tag").isNotNull() & F.col("n_pad").isNull()).cast("int")).alias("_miss"))
    j = j.join(miss, key).withColumn("piece_out", out).withColumn(
        "status", F.when(F.col("_miss") == 1, "missing_grid").otherwise("ok"))
    return reassemble(j, key, "turn", "piece_out", "content", extra=("status",)).select(key, "turn", "status", "content")


def partition_vision(segments: DataFrame, key: str = "conv_id", segment: str = "s", fps: str = "sample_fps") -> DataFrame:
    """Per record the ordered references of its images (``image`` or
    ``image_url``) and of its videos with their sampled fps, null when there
    are none; ``status`` is ``no_media_key`` if an element of a visual type
    has none of the three keys.  ``segments``: (key, turn, seg_no, segment,
    fps)."""
    v = vision_element_columns(F.col(segment))
    o = F.struct("turn", "seg_no", v["ref"].alias("ref"), F.col(fps).alias("fps"))
    is_kind = lambda k: F.coalesce(v["is_vision"] & (v["kind"] == k), F.lit(False))
    g = segments.groupBy(key).agg(
        F.sort_array(F.collect_list(F.when(is_kind("image"), o))).alias("im"),
        F.sort_array(F.collect_list(F.when(is_kind("video"), o))).alias("vi"),
        F.max((v["status"] != "ok").cast("int")).alias("_bad"))
    text = lambda a, f: F.nullif(F.array_join(F.transform(a, lambda z: z[f]), ","), F.lit(""))
    return g.select(key, F.size("im").cast("bigint").alias("n_images"), F.size("vi").cast("bigint").alias("n_videos"),
                    text("im", "ref").alias("images"), text("vi", "ref").alias("videos"), text("vi", "fps").alias("video_fps"),
                    F.when(F.col("_bad") == 1, "no_media_key").otherwise("ok").alias("status"))


def precomputed_length(df: DataFrame, tokens: str = "num_tokens", out: str = "length") -> DataFrame:
    """The record's own token count, 1 where it has none."""
    n = F.col(tokens) if tokens in df.columns else F.lit(None).cast("bigint")
    return df.withColumn(out, F.coalesce(n, F.lit(1)).cast("bigint"))
