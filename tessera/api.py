"""Job-level entry points (curate, convert, validate, prepare, enhance,
evaluate), composed from the DataFrame operators.  Paths may be local or on
shared storage; nothing passes through the driver but counts."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import tokens as TK
from .operators import batching as B
from .operators import chat as C
from .operators import factor as FA
from .operators import metrics as M
from .operators import positions as P
from .operators import rows as R
from .operators import score as S
from .operators import subwords as SW
from .operators import text as X
from .operators import validate as V
from .sources import files as SRC


def curate(prompts: DataFrame, output_dir: str | None = None, train_ratio: float = 0.8,
           image_vec: str = "image_vec", text_vec: str = "text_vec",
           make_predict_fn: Callable | None = None, dim: int | None = None, batch_size: int = 64) -> DataFrame:
    """Score (image, text) pairs, rank by score, split train/test.

    Scores are the cosine of the two feature columns, or - with
    ``make_predict_fn`` - a batched model call over ``image_vec`` (rows whose
    batch failed are dropped, as the reference drops failed batches).
    With ``output_dir`` the result is written as CSV, one folder per split.
    """
    if make_predict_fn is not None:
        scored = X.drop_failed(S.batch_score(prompts, make_predict_fn, image_vec, dim, out="similarity",
                                             batch_size=batch_size), "similarity")
    else:
        scored = S.pair_cosine(prompts, image_vec, text_vec)
    out = R.ratio_split(scored.drop(image_vec, text_vec), S.rank_order("similarity", "id"), train_ratio,
                        pos="rank")
    if output_dir:
        SRC.write_csv(out.drop("rank"), output_dir, partition_by="split")
    return out


def convert(split_rows: DataFrame, out_path: str | None = None, min_tokens: int = X.MIN_TOKENS,
            max_tokens: int = X.MAX_TOKENS, vocabulary: str | None = None) -> DataFrame:
    """Prompts with at least ``min_tokens`` tokens -> training conversations
    (system, user[image, original prompt], assistant[truncated prompt]) as
    JSONL text; with ``out_path`` written one folder per split.  Tokens are
    words, or the subwords of ``vocabulary`` (a file)."""
    if vocabulary:
        kept, cut = SW.truncate_subwords(split_rows, vocabulary, "id", "prompt", min_tokens, max_tokens, "_cut"), "_cut"
    else:
        kept, cut = X.min_token_filter(split_rows, "prompt", min_tokens, out=None), X.truncate_tokens("prompt", max_tokens)
    conv = C.training_conversation("url", "prompt", cut)
    cols = ["split"] if "split" in split_rows.columns else []
    out = kept.select("id", *cols, C.to_jsonl(conv).alias("json"))
    if out_path:
        w = out.select(*cols, F.col("json").alias("value")).write.mode("overwrite")
        (w.partitionBy(*cols) if cols else w).text(out_path)
    return out


def validate_data(spark: SparkSession, json_file_path: str, media_folder_path: str, output_path: str | None = None,
                  listing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Check media existence and placeholder consistency of an annotation
    file against a media folder (or a ``listing`` of its paths).  A record is
    known by its place in the file, so equal records count each.  Returns
    (checked records, one-row summary); with ``output_path`` the records are
    written as JSON, one folder per status (valid / problem)."""
    ann = SRC.annotation_lines(spark, json_file_path).withColumnRenamed("record", "id")
    root = media_folder_path.rstrip("/")
    if listing is None:
        # the listing reports qualified paths (file:/...); compare in that form
        listing = SRC.media_listing(spark, media_folder_path).select(F.regexp_replace("path", r"^file:", "").alias("path"))
    keep = ["id", "v"] + (["line"] if "line" in ann.columns else [])
    checked = V.problems(V.prepare(ann.select(*keep)), "id", listing, root)
    if output_path:
        V.write_split(checked, output_path)
    return checked, V.summary(checked, "id")


def record_key(records: DataFrame) -> Column:
    """What a record is known by: its place in the list, which the reader
    gives; else its id."""
    return F.col("record" if "record" in records.columns else "id").alias("conv_id")


def record_media(records: DataFrame) -> DataFrame:
    """(conv_id, kind, k, file): the media files of reader output, k in the
    order of each kind; joined with the sizes of the files, the ``grid`` of
    ``prepare``."""
    kinds = [records.select(record_key(records), F.lit(kind).alias("kind"), F.posexplode(column).alias("k", "file"))
             for kind, column in (("image", "images"), ("video", "videos"))]
    return kinds[0].unionByName(kinds[1]).withColumn("k", F.col("k").cast("bigint"))


def reader_turns(records: DataFrame) -> DataFrame:
    """Reader output (record or id, turns, images, videos) as one row per
    turn, with a leading answer dropped: (conv_id, turn, role, flat)."""
    kept = C.drop_leading_nonuser("turns", F.get("turns", 0)["from_value"])
    x = records.select(record_key(records), F.posexplode(kept).alias("turn", "t"))
    return x.select("conv_id", F.col("turn").cast("bigint"), F.col("t.role").alias("role"),
                    F.coalesce("t.content", F.lit("")).alias("flat"))


def prepare(records: DataFrame, grid: DataFrame, batch_size: int = 4, max_len: int = B.MODEL_MAX_LENGTH,
            pad_id: int = TK.PAD_ID, packed: bool = False) -> DataFrame:
    """Training batches from reader output: turns, visual expansion, token
    ids with labels, batch numbers in the order of the records, and either
    padded rows (batch, conv_id, pos, id, label, mask) or packed rows (batch,
    pos, id, label).  conv_id is the record's place in the list, or its id
    where the records have no such column.  ``grid``: (conv_id, kind, k, gt,
    gh, gw, sec), see ``record_media``."""
    seg = P.segments(reader_turns(records), grid, ids=True)
    spans = R.batch_assign(P.sample_spans(seg, max_len=max_len).checkpoint(eager=True), batch_size, ["conv_id"])
    tokens = P.token_rows(seg)
    if packed:
        return B.pack_token_rows(tokens, B.pack_batch(spans, "conv_id"), "conv_id")
    return B.pad_token_rows(tokens, spans, "conv_id", pad_id, max_len)


def enhance(prompts: DataFrame, responses: DataFrame, key: str = "id", min_words: int = X.MIN_WORDS) -> DataFrame:
    """Prompts with the enhanced prompt of their response: text after the
    last marker, of at least ``min_words`` words; rows without one go."""
    got = X.extract_enhanced(responses.select(key, "response"))
    got = X.min_word_filter(got, "enhanced_prompt", min_words).select(key, "enhanced_prompt")
    return prompts.withColumnRenamed("prompt", "original_prompt").join(got, key)


def evaluate(features: DataFrame, probs: str, img: str, txt: str, side: str, real, generated) -> tuple[DataFrame, float]:
    """(per side n, Inception Score and CLIP score; Fréchet distance)."""
    return (M.report(features, probs, img, txt, [side]),
            FA.frechet_distance(features, img, side, real, generated))
