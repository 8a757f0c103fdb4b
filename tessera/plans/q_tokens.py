"""Registered queries: loss masks, 3-D positions, padding and packing
(C13, G15-G17, H2-H6) over conversation samples."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import batching as B
from ..operators import positions as P
from ..operators import rows as R
from . import fixtures as FX
from .registry import loader, query
from .sqlfrag import lit, word_count, words

W = FX.with_ctes
BATCH = 4


def grid_k(tr):
    """Ordinal of each media file per (sample, kind) in turn order."""
    return R.running_sums(FX.media_grid(tr), ["turn"], ["conv_id", "kind"], {"k": F.lit(1).cast("bigint")})


def seg(spark, d, time_scale=True, ids=False):
    tr = FX.turns(loader(spark, d))
    return P.segments(tr, grid_k(tr), time_scale=time_scale, ids=ids)


def _seg_sql(time_scale: bool) -> str:
    tau = "CAST(floor((g.gt - 1) * g.sec * 2) AS BIGINT)" if time_scale else "g.gt - 1"
    return f"""grid_k AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id, kind ORDER BY turn) - 1 AS BIGINT) AS k
           FROM media_grid),
stags AS (SELECT conv_id, CASE WHEN bool_or(kind = 'image') THEN '<image>' ELSE '<video>' END AS stag
          FROM media_grid GROUP BY conv_id),
pieces0 AS (
  SELECT t.conv_id, t.turn, t.role, coalesce(s.stag, '<image>') AS stag,
         CASE WHEN t.role = 'user' THEN string_split(t.flat, coalesce(s.stag, '<image>')) ELSE [t.flat] END AS parts
  FROM turns t LEFT JOIN stags s ON s.conv_id = t.conv_id),
pieces AS (
  SELECT conv_id, turn, role, stag, unnest(parts) AS piece,
         CAST(generate_subscripts(parts, 1) - 1 AS BIGINT) AS piece_no, CAST(len(parts) AS BIGINT) AS n_pieces
  FROM pieces0),
tagged AS (SELECT *, CASE WHEN piece_no < n_pieces - 1 THEN stag END AS tag FROM pieces),
kinded AS (
  SELECT *, CASE tag WHEN '<image>' THEN 'image' WHEN '<video>' THEN 'video' END AS kind,
         CASE WHEN tag IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY conv_id, tag ORDER BY turn, piece_no) - 1
                                            AS BIGINT) END AS tag_index
  FROM tagged),
seg0 AS (
  SELECT p.*, g.gt, g.gh, g.gw, g.sec,
    CAST((CASE WHEN piece_no = 0 THEN 3 ELSE 1 END) + {word_count('piece')}
         + (CASE WHEN tag IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN piece_no = n_pieces - 1 THEN 2 ELSE 0 END)
         + (CASE WHEN row_number() OVER (PARTITION BY p.conv_id ORDER BY p.turn, p.piece_no) = 1 THEN {P.SYSTEM_BLOCK}
            ELSE 0 END) AS BIGINT) AS chunk_len,
    CAST(g.gh / 2 AS BIGINT) AS hm, CAST(g.gw / 2 AS BIGINT) AS wm,
    CAST(CASE WHEN tag IS NOT NULL THEN coalesce(CAST(g.gt * g.gh * g.gw / 4 AS BIGINT), 0) ELSE 0 END AS BIGINT) AS n_pad,
    CAST(CASE WHEN tag IS NOT NULL THEN coalesce(greatest({tau}, CAST(g.gh / 2 AS BIGINT) - 1,
                                                         CAST(g.gw / 2 AS BIGINT) - 1) + 1, 0) ELSE 0 END AS BIGINT) AS mw,
    (tag IS NOT NULL AND g.gt IS NULL) AS miss
  FROM kinded p LEFT JOIN grid_k g ON g.conv_id = p.conv_id AND g.kind = p.kind AND g.k = p.tag_index),
seg AS (
  SELECT *, CAST(coalesce(sum(chunk_len + n_pad) OVER w, 0) AS BIGINT) AS seq_start,
         CAST(coalesce(sum(chunk_len + mw) OVER w, 0) AS BIGINT) AS pid_start,
         bool_or(miss) OVER (PARTITION BY conv_id) AS rejected
  FROM seg0 WINDOW w AS (PARTITION BY conv_id ORDER BY turn, piece_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _pos_sql(time_scale: bool) -> str:
    tau = "CAST(floor(floor(m / (hm * wm)) * sec * 2) AS BIGINT)" if time_scale else "CAST(floor(m / (hm * wm)) AS BIGINT)"
    return f"""pos3 AS (
  SELECT conv_id, seq_start + j AS pos, pid_start + j AS t, pid_start + j AS h, pid_start + j AS w
  FROM (SELECT *, unnest(generate_series(0, chunk_len - 1)) AS j FROM seg WHERE NOT rejected)
  UNION ALL
  SELECT conv_id, seq_start + chunk_len + m, pid_start + chunk_len + {tau},
         pid_start + chunk_len + CAST(floor((m % (hm * wm)) / wm) AS BIGINT), pid_start + chunk_len + m % wm
  FROM (SELECT *, unnest(generate_series(0, n_pad - 1)) AS m FROM seg WHERE NOT rejected AND n_pad > 0))"""


BASE = W(FX.TURNS_SQL, FX.MEDIA_GRID_SQL, _seg_sql(True))
BASE_PLAIN = W(FX.TURNS_SQL, FX.MEDIA_GRID_SQL, _seg_sql(False))
LENS_SQL = f""",
lens AS (SELECT conv_id, CAST(sum(chunk_len + n_pad) AS BIGINT) AS seq_len FROM seg WHERE NOT rejected GROUP BY conv_id),
bat AS (SELECT *, CAST(row_number() OVER (ORDER BY conv_id) - 1 AS BIGINT) AS pos FROM lens),
bat2 AS (SELECT *, CAST(floor(pos / {BATCH}) AS BIGINT) AS batch FROM bat),
spans AS (
  SELECT conv_id, turn, role, min(seq_start + CASE WHEN seq_start = 0 THEN {P.SYSTEM_BLOCK} ELSE 0 END) AS start,
         sum(chunk_len + n_pad - CASE WHEN seq_start = 0 THEN {P.SYSTEM_BLOCK} ELSE 0 END) AS length,
         sum(coalesce(list_sum(list_transform({words('piece')},
             lambda w: CAST(('0x' || substr(md5(w), 1, 8)) AS BIGINT) % 151643)), 0)) AS word_id_sum
  FROM seg WHERE NOT rejected GROUP BY conv_id, turn, role)"""


@query("loss_mask", BASE + LENS_SQL + """
SELECT l.conv_id, l.seq_len AS n_tokens,
       CAST(sum(CASE WHEN role NOT IN ('user', 'system') THEN length - 3 ELSE 0 END) AS BIGINT) AS n_supervised,
       CAST(sum(CASE WHEN role NOT IN ('user', 'system') THEN word_id_sum + 151645 + 198 ELSE 0 END) AS BIGINT)
         AS label_sum
FROM lens l JOIN spans s USING (conv_id) GROUP BY l.conv_id, l.seq_len""")
def loss_mask(spark, d):
    return P.loss_mask(seg(spark, d, ids=True)).select("conv_id", "n_tokens", "n_supervised", "label_sum")


@query("positions_3d", BASE + ",\n" + _pos_sql(True) + "\nSELECT conv_id, pos, t, h, w FROM pos3")
def positions_3d(spark, d):
    return P.positions_3d(seg(spark, d)).select("conv_id", "pos", "t", "h", "w")


@query("positions_3d_plain", BASE_PLAIN + ",\n" + _pos_sql(False) + "\nSELECT conv_id, pos, t, h, w FROM pos3")
def positions_3d_plain(spark, d):
    return P.positions_3d(seg(spark, d, time_scale=False), time_scale=False).select("conv_id", "pos", "t", "h", "w")


def batched(seg_):
    """Per accepted sample its spans and batch number, in the order of the
    sample key: a narrow table that is computed once."""
    spans = P.sample_spans(seg_, max_len=B.MODEL_MAX_LENGTH).checkpoint(eager=True)
    return R.batch_assign(spans, BATCH, ["conv_id"])


@query("pad_batch", BASE + LENS_SQL + """
SELECT b.conv_id, b.batch, b.seq_len,
       CAST(least(max(b.seq_len) OVER (PARTITION BY b.batch), 512) AS BIGINT) AS padded_len,
       CAST(least(b.seq_len, 512) AS BIGINT) AS n_attended, coalesce(k.kept, 0) AS n_supervised_kept
FROM bat2 b LEFT JOIN (
  SELECT conv_id, CAST(sum(greatest(least(start + length, 512) - least(start + 3, 512), 0)) AS BIGINT) AS kept
  FROM spans WHERE role NOT IN ('user', 'system') GROUP BY conv_id) k ON k.conv_id = b.conv_id""")
def pad_batch(spark, d):
    p = B.pad_batch(batched(seg(spark, d)))
    return p.select("conv_id", "batch", "seq_len", "padded_len", "n_attended", "n_supervised_kept")


@query("pack_batch", BASE + LENS_SQL + """
SELECT conv_id, batch,
       CAST(sum(seq_len) OVER (PARTITION BY batch ORDER BY pos ROWS UNBOUNDED PRECEDING) - seq_len AS BIGINT) AS cu_start,
       CAST(sum(seq_len) OVER (PARTITION BY batch ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cu_end,
       CAST(max(seq_len) OVER (PARTITION BY batch) AS BIGINT) AS max_seqlen
FROM bat2""")
def pack_batch(spark, d):
    return B.pack_batch(batched(seg(spark, d)), "conv_id").select("conv_id", "batch", "cu_start", "cu_end", "max_seqlen")


@query("batch_media", BASE + LENS_SQL + """
SELECT b.batch,
       string_agg(CASE WHEN m.kind = 'image' THEN m.file END, ',' ORDER BY b.pos, m.turn) AS images,
       string_agg(CASE WHEN m.kind = 'video' THEN m.file END, ',' ORDER BY b.pos, m.turn) AS videos,
       CAST(sum(CASE WHEN m.kind = 'image' THEN m.gt * m.gh * m.gw // 4 END) AS BIGINT) AS image_tokens,
       CAST(sum(CASE WHEN m.kind = 'video' THEN m.gt * m.gh * m.gw // 4 END) AS BIGINT) AS video_tokens
FROM bat2 b LEFT JOIN stags s ON s.conv_id = b.conv_id
LEFT JOIN media_grid m ON m.conv_id = b.conv_id AND m.kind = CASE WHEN s.stag = '<image>' THEN 'image' ELSE 'video' END
GROUP BY b.batch""")
def batch_media(spark, d):
    tr = FX.turns(loader(spark, d))
    lb = batched(P.segments(tr, grid_k(tr)))
    # a sample contributes the media of the kind it is processed with
    kinds = P.sample_tags(FX.media_grid(tr)).select(
        "conv_id", F.when(F.col("_stag") == "<image>", "image").otherwise("video").alias("kind"))
    media = FX.media_grid(tr).join(kinds, ["conv_id", "kind"]).select(
        "conv_id", "kind", "turn", "file", (F.col("gt") * F.col("gh") * F.col("gw") / 4).cast("bigint").alias("tokens"))
    return B.batch_media(lb, media, "conv_id")


@query("pad_positions", BASE + LENS_SQL + ",\n" + _pos_sql(True) + """
SELECT conv_id, pos, t, h, w FROM pos3
UNION ALL
SELECT conv_id, pos, 1, 1, 1 FROM (
  SELECT conv_id, unnest(generate_series(seq_len, bmax - 1)) AS pos
  FROM (SELECT *, max(seq_len) OVER (PARTITION BY batch) AS bmax FROM bat2))""")
def pad_positions(spark, d):
    """3-D positions padded with 1 to the batch maximum (the reference
    cuts position ids on the batch axis, so no sequence cut here)."""
    s = seg(spark, d)
    return B.pad_position_rows(P.positions_3d(s), batched(s), "conv_id")


@query("positions_text", BASE + LENS_SQL + """
SELECT conv_id, pos, CASE WHEN pos < seq_len THEN pos ELSE 1 END AS position_id FROM (
  SELECT conv_id, seq_len, unnest(generate_series(0, least(bmax, 512) - 1)) AS pos
  FROM (SELECT *, max(seq_len) OVER (PARTITION BY batch) AS bmax FROM bat2))""")
def positions_text(spark, d):
    """Text positions from the attention mask of the padded, cut batch:
    cumsum(mask) - 1, masked slots 1."""
    return B.text_positions(batched(seg(spark, d)), "conv_id")


_DELTA = "\nSELECT conv_id, CAST(max(greatest(t, h, w)) + 1 - count(*) AS BIGINT) AS delta FROM pos3 GROUP BY conv_id"


@query("position_deltas", BASE + ",\n" + _pos_sql(True) + _DELTA)
def position_deltas(spark, d):
    return P.position_deltas(seg(spark, d))


@query("position_deltas_plain", BASE_PLAIN + ",\n" + _pos_sql(False) + _DELTA)
def position_deltas_plain(spark, d):
    return P.position_deltas(seg(spark, d, time_scale=False))


# ---------------------------------------------------------------- token ids, labels, masks
def _id_sql(x: str) -> str:
    return f"(CAST(('0x' || substr(md5({x}), 1, 8)) AS BIGINT) % 151643)"


_SYSTEM_IDS = (f"list_concat([151644, {_id_sql(lit('system'))}, 198], list_transform({words(lit(K.DEFAULT_SYSTEM))}, "
               f"lambda w: {_id_sql('w')}), [151645, 198])")
TOKENS_SQL = LENS_SQL + f""",
tok0 AS (
  SELECT conv_id, role, seq_start,
         CASE WHEN seq_start = 0 THEN {P.SYSTEM_BLOCK} ELSE 0 END + CASE WHEN piece_no = 0 THEN 3 ELSE 0 END AS head,
         flatten([CASE WHEN seq_start = 0 THEN {_SYSTEM_IDS} ELSE []::BIGINT[] END,
                  CASE WHEN piece_no = 0 THEN [151644, {_id_sql('role')}, 198] ELSE [151653] END,
                  list_transform({words('piece')}, lambda w: {_id_sql('w')}),
                  CASE WHEN tag IS NOT NULL THEN [151652] ELSE []::BIGINT[] END,
                  CASE WHEN piece_no = n_pieces - 1 THEN [151645, 198] ELSE []::BIGINT[] END,
                  list_transform(range(n_pad), lambda i: CASE kind WHEN 'image' THEN 151655 ELSE 151656 END)]::BIGINT[][]) AS ids
  FROM seg WHERE NOT rejected),
tok AS (
  SELECT conv_id, CAST(seq_start + u AS BIGINT) AS pos, id,
         CAST(CASE WHEN role NOT IN ('user', 'system') AND u >= head THEN id ELSE -100 END AS BIGINT) AS label
  FROM (SELECT conv_id, role, seq_start, head, unnest(ids) AS id, generate_subscripts(ids, 1) - 1 AS u FROM tok0))"""

#: a pad id that real tokens have too (the id of a frequent word), so that the mask by value is put to the test
PAD_WORD = "the"
_PAD = int(hashlib.md5(PAD_WORD.encode()).hexdigest()[:8], 16) % 151643


@query("token_labels", BASE + TOKENS_SQL + "\nSELECT conv_id, pos, id, label FROM tok")
def token_labels(spark, d):
    """Token ids and loss labels of every sample."""
    return P.token_rows(seg(spark, d, ids=True)).select("conv_id", "pos", "id", "label")


@query("pad_batch_tokens", BASE + TOKENS_SQL + f""",
bl AS (SELECT conv_id, batch, seq_len, least(max(seq_len) OVER (PARTITION BY batch), 512) AS plen FROM bat2),
rows_ AS (
  SELECT batch, conv_id, pos, id, label FROM tok JOIN bl USING (conv_id) WHERE pos < 512
  UNION ALL
  SELECT batch, conv_id, unnest(range(seq_len, plen)), {_PAD}, -100 FROM bl WHERE seq_len < plen)
SELECT batch, conv_id, CAST(pos AS BIGINT) AS pos, CAST(id AS BIGINT) AS id, CAST(label AS BIGINT) AS label,
       CAST(id <> {_PAD} AS INTEGER) AS mask FROM rows_""")
def pad_batch_tokens(spark, d):
    """Padded and cut batches as token rows with labels and mask."""
    s = seg(spark, d, ids=True)
    return B.pad_token_rows(P.token_rows(s), batched(s), "conv_id", _PAD)


@query("pack_batch_tokens", BASE + TOKENS_SQL + """,
pk AS (SELECT conv_id, batch, sum(seq_len) OVER (PARTITION BY batch ORDER BY pos ROWS UNBOUNDED PRECEDING) - seq_len AS cu
       FROM bat2)
SELECT batch, CAST(cu + pos AS BIGINT) AS pos, id, label FROM tok JOIN pk USING (conv_id)""")
def pack_batch_tokens(spark, d):
    """Packed batches as one token sequence each."""
    s = seg(spark, d, ids=True)
    return B.pack_token_rows(P.token_rows(s), B.pack_batch(batched(s), "conv_id"), "conv_id")


# ---------------------------------------------------------------- records without ids
KEYLESS_BASE = W(FX.TURNS_SQL.replace("turns AS (", "all_turns AS (", 1), """firsts AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM all_turns),
turns AS (SELECT * EXCLUDE (rn) FROM firsts WHERE NOT (rn = 1 AND role = 'assistant'))""", FX.MEDIA_GRID_SQL, _seg_sql(True))


@query("keyless_records", KEYLESS_BASE + LENS_SQL + """
SELECT n_tokens, n_supervised, label_sum, CAST(sum(CASE WHEN conv_id % 4 = 1 THEN 2 ELSE 1 END) AS BIGINT) AS n_records
FROM (SELECT l.conv_id, l.seq_len AS n_tokens,
             CAST(sum(CASE WHEN role NOT IN ('user', 'system') THEN length - 3 ELSE 0 END) AS BIGINT) AS n_supervised,
             CAST(sum(CASE WHEN role NOT IN ('user', 'system') THEN word_id_sum + 151645 + 198 ELSE 0 END) AS BIGINT) AS label_sum
      FROM lens l JOIN spans s USING (conv_id) GROUP BY l.conv_id, l.seq_len)
GROUP BY n_tokens, n_supervised, label_sum""")
def keyless_records(spark, d):
    """Token rows of annotation lines that have no id, some of them repeated:
    each line is a sample of its own."""
    from .. import api
    from ..session import scratch_path
    from ..sources import files as SRC
    from . import annotations as AN
    t = loader(spark, d)
    path = scratch_path(spark, "keyless") + ".jsonl"
    SRC.write_jsonl(AN.keyless_lines(t), "line", path)
    records = SRC.read_annotations(spark, path)
    grid = api.record_media(records).join(FX.media_grid(FX.turns(t)).drop("conv_id", "turn", "kind"), "file")
    rows = P.token_rows(P.segments(api.reader_turns(records), grid, ids=True))
    own = F.col("label") != -100
    each = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.count_if(own).cast("bigint").alias("n_supervised"),
                                       F.coalesce(F.sum(F.when(own, F.col("label"))), F.lit(0)).alias("label_sum"))
    return each.groupBy("n_tokens", "n_supervised", "label_sum").agg(F.count(F.lit(1)).alias("n_records"))
