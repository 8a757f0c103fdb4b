"""Token segments, loss masks and 3-D position ids of chat samples.

A sample is a conversation rendered with the chat template (default
system turn first), processed for one visual kind: image when it has image
files, else video.  User turns are split on that kind's tag (the other
kind's tag stays literal text); each tag becomes
``<|vision_start|>`` + pads + ``<|vision_end|>`` with as many pads as its
grid has merged patches.  Everything is computed on a *segment table* -
one row per text chunk followed by at most one media block - with running
sums partitioned by sample; token rows are generated last with
``explode(sequence)``.  No window spans more than one sample.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..functions import tokens as TK
from ..session import ensure_checkpoint_dir
from . import chat as C

SYSTEM_BLOCK = 3 + len(K.DEFAULT_SYSTEM.split()) + 2   # header + words + footer


def segments(turns: DataFrame, grid: DataFrame, key: str = "conv_id", time_scale: bool = True, ids: bool = False) -> DataFrame:
    """One row per (sample, turn, piece) with

    chunk_len   text tokens of the chunk (turn header, VISION_END of the
                previous block, words, VISION_START, turn footer, and the
                default system block on the first chunk),
    n_pad       media tokens after the chunk (0 when none),
    mw          position width of the media block,
    seq_start / pid_start   running offsets in token and position space,
    rejected    sample has a tag without a grid entry,
    word_ids    (with ``ids``) the token ids of its words, and their sum.
                Lengths and positions need none, and then no word is hashed.

    ``grid``: (key, kind, k, gt, gh, gw, sec) with k the ordinal of the
    media file per kind in the sample.
    """
    from .rows import running_sums
    p = C.tag_pieces(turns.select(key, "turn", "role", "flat"), key, "turn", "flat", active=sample_tags(grid, key))
    p = p.withColumn("kind", F.when(F.col("tag") == K.IMAGE_TAG, "image").when(F.col("tag") == K.VIDEO_TAG, "video"))
    # per-piece values computed once; the text is dropped before the offset pass
    words = T.word_count("piece").alias("n_words") if not ids else TK.token_ids(T.words("piece")).alias("word_ids")
    p = p.select(key, "turn", "role", "_piece_no", "n_pieces", "tag", "kind", "tag_index", "_before_rows", words)
    if ids:
        p = p.withColumns({"n_words": F.size("word_ids").cast("bigint"),
                           "word_id_sum": F.aggregate("word_ids", F.lit(0).cast("bigint"), lambda a, x: a + x)})
    g = grid.select(key, "kind", F.col("k").alias("tag_index"), "gt", "gh", "gw", "sec")
    p = p.join(g, [key, "kind", "tag_index"], "left")
    first = F.col("_before_rows") == 0
    has_tag = F.col("tag").isNotNull()
    chunk = (F.when(F.col("_piece_no") == 0, 3).otherwise(1) + F.col("n_words")
             + F.when(has_tag, 1).otherwise(0)
             + F.when(F.col("_piece_no") == F.col("n_pieces") - 1, 2).otherwise(0)
             + F.when(first, SYSTEM_BLOCK).otherwise(0))
    hm, wm = (F.col("gh") / 2).cast("bigint"), (F.col("gw") / 2).cast("bigint")
    tau_last = (F.floor((F.col("gt") - 1) * F.col("sec") * 2) if time_scale else F.col("gt") - 1).cast("bigint")
    n_pad = (F.col("gt") * F.col("gh") * F.col("gw") / 4).cast("bigint")
    mw = F.greatest(tau_last, hm - 1, wm - 1) + 1
    p = p.withColumns({
        "chunk_len": chunk.cast("bigint"), "hm": hm, "wm": wm,
        "n_pad": F.when(has_tag, F.coalesce(n_pad, F.lit(0))).otherwise(0).cast("bigint"),
        "mw": F.when(has_tag, F.coalesce(mw, F.lit(0))).otherwise(0).cast("bigint"),
        "miss": (has_tag & F.col("gt").isNull()).cast("int")})
    # the texts end here: what follows reads this narrow table
    ensure_checkpoint_dir(p.sparkSession)
    p = p.checkpoint(eager=True)
    p = running_sums(p, ["turn", "_piece_no"], [key], {
        "seq_start": F.col("chunk_len") + F.col("n_pad"), "pid_start": F.col("chunk_len") + F.col("mw")})
    # sample-level reject flag: a partial aggregation joined back (AQE splits a skewed key)
    rej = p.groupBy(key).agg((F.max("miss") == 1).alias("rejected"))
    return p.join(rej, key)


def positions_3d(seg: DataFrame, key: str = "conv_id", time_scale: bool = True) -> DataFrame:
    """(key, pos, t, h, w) for every token of every accepted sample.

    Text token j of a chunk: pid_start + j on all axes.  Media token m,
    ordered (i, y, x): pid_start + chunk_len + (tau(i), y, x), with
    tau(i) = int(i * seconds_per_grid * 2) (or i without time scaling).
    """
    ok = seg.filter(~F.col("rejected"))
    # one generator per segment row: u < chunk_len are text tokens, the rest media
    u = ok.select(key, "seq_start", "pid_start", "chunk_len", "hm", "wm", "sec",
                  F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunk_len") + F.col("n_pad") - 1)).alias("u"))
    m = F.col("u") - F.col("chunk_len")
    hw = F.col("hm") * F.col("wm")
    i = F.floor(m / hw)
    tau = F.floor(i * F.col("sec") * 2) if time_scale else i
    base = F.col("pid_start") + F.col("chunk_len")
    is_text = F.col("u") < F.col("chunk_len")
    txt = F.col("pid_start") + F.col("u")
    return u.select(key, (F.col("seq_start") + F.col("u")).alias("pos"),
                    F.when(is_text, txt).otherwise(base + tau).cast("bigint").alias("t"),
                    F.when(is_text, txt).otherwise(base + F.floor((m % hw) / F.col("wm"))).cast("bigint").alias("h"),
                    F.when(is_text, txt).otherwise(base + m % F.col("wm")).cast("bigint").alias("w"))


def position_deltas(seg: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, delta): last position + 1 minus the number of tokens, what
    generation adds to the token count to go on."""
    ok = seg.filter(~F.col("rejected"))
    return ok.groupBy(key).agg(F.sum(F.col("mw") - F.col("n_pad")).cast("bigint").alias("delta"))


def sample_tags(grid: DataFrame, key: str = "conv_id") -> DataFrame:
    """The one visual kind a sample is processed with: image when it has
    image files, else video when it has video files (samples without
    media are text-only, where an image tag has no grid)."""
    g = grid.groupBy(key).agg(F.max((F.col("kind") == "image").cast("int")).alias("_hi"))
    return g.select(key, F.when(F.col("_hi") == 1, F.lit(K.IMAGE_TAG)).otherwise(F.lit(K.VIDEO_TAG)).alias("_stag"))


def turn_spans(seg: DataFrame, key: str = "conv_id") -> DataFrame:
    """Per accepted (sample, turn): role, token start, token length; the
    default system block is not part of any turn."""
    ok = seg.filter(~F.col("rejected"))
    first = F.col("seq_start") == 0
    g = ok.groupBy(key, "turn", "role").agg(
        F.min(F.col("seq_start") + F.when(first, SYSTEM_BLOCK).otherwise(0)).alias("start"),
        F.sum(F.col("chunk_len") + F.col("n_pad") - F.when(first, SYSTEM_BLOCK).otherwise(0)).alias("length"),
        F.sum("n_words").alias("n_words"),
        *([F.sum("word_id_sum").alias("word_id_sum")] if "word_id_sum" in seg.columns else []))
    return g


def sample_spans(seg: DataFrame, key: str = "conv_id", max_len: int | None = None) -> DataFrame:
    """Per accepted sample, in one pass over its turns: seq_len tokens,
    n_supervised tokens (every turn that is not user or system, minus its
    3-token header), of these n_supervised_kept before ``max_len``, and, for
    segments with ids, label_sum, the sum of the supervised label ids."""
    sp = turn_spans(seg, key)
    asst = ~F.col("role").isin("user", "system")
    cut = F.lit(max_len) if max_len else F.col("start") + F.col("length")
    lo, hi = F.least(F.col("start") + 3, cut), F.least(F.col("start") + F.col("length"), cut)
    return sp.groupBy(key).agg(
        (F.sum("length") + SYSTEM_BLOCK).cast("bigint").alias("seq_len"),
        F.sum(F.when(asst, F.col("length") - 3).otherwise(0)).cast("bigint").alias("n_supervised"),
        F.sum(F.when(asst, F.greatest(hi - lo, F.lit(0))).otherwise(0)).cast("bigint").alias("n_supervised_kept"),
        *([F.sum(F.when(asst, F.col("word_id_sum") + TK.IM_END_ID + TK.NEWLINE_ID).otherwise(0)).cast("bigint").alias("label_sum")]
          if "word_id_sum" in seg.columns else []))


def loss_mask(seg: DataFrame, key: str = "conv_id") -> DataFrame:
    """Per sample: tokens, supervised tokens and the sum of their labels
    (segments with ids)."""
    return sample_spans(seg, key).select(key, F.col("seq_len").alias("n_tokens"), "n_supervised", "label_sum")


def _ids(*values) -> "F.Column":
    return F.array(*[F.lit(v).cast("bigint") if isinstance(v, int) else v for v in values])


def token_rows(seg: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, pos, id, label) of every token of every accepted sample
    (segments with ids).

    A turn is header (start, role, newline), words and footer (end, newline);
    a media block is start, pads, end; the default system block comes first.
    Labels are the ids of the turns that are not user or system, without
    their header, else ``IGNORE_INDEX``."""
    none = F.array().cast("array<bigint>")
    first, has_tag = F.col("seq_start") == 0, F.col("tag").isNotNull()
    system = F.concat(_ids(TK.IM_START_ID, TK.token_id(F.lit("system")), TK.NEWLINE_ID),
                      TK.token_ids(T.words(F.lit(K.DEFAULT_SYSTEM))), _ids(TK.IM_END_ID, TK.NEWLINE_ID))
    pad = F.when(F.col("kind") == "image", TK.IMAGE_PAD_ID).otherwise(TK.VIDEO_PAD_ID).cast("bigint")
    ids = F.concat(
        F.when(first, system).otherwise(none),
        F.when(F.col("_piece_no") == 0, _ids(TK.IM_START_ID, TK.token_id(F.col("role")), TK.NEWLINE_ID))
        .otherwise(_ids(TK.VISION_END_ID)),
        F.col("word_ids"),
        F.when(has_tag, _ids(TK.VISION_START_ID)).otherwise(none),
        F.when(F.col("_piece_no") == F.col("n_pieces") - 1, _ids(TK.IM_END_ID, TK.NEWLINE_ID)).otherwise(none),
        F.array_repeat(pad, F.col("n_pad").cast("int")))
    head = F.when(first, SYSTEM_BLOCK).otherwise(0) + F.when(F.col("_piece_no") == 0, 3).otherwise(0)
    x = seg.filter(~F.col("rejected")).select(key, "role", "seq_start", head.alias("_head"), F.posexplode(ids).alias("u", "id"))
    own = ~F.col("role").isin("user", "system") & (F.col("u") >= F.col("_head"))
    return x.select(key, (F.col("seq_start") + F.col("u")).cast("bigint").alias("pos"), "id",
                    F.when(own, F.col("id")).otherwise(TK.IGNORE_INDEX).cast("bigint").alias("label"))
