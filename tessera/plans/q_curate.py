"""Registered queries: curation (score, rank, split, sample) and text prep."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.constants import TRAIN_SYSTEM_MESSAGE
from ..operators import chat as C
from ..operators import rows as R
from ..operators import score as S
from ..operators import select as SEL
from ..operators import subwords as SW
from ..operators import text as X
from ..session import scratch_path
from . import fixtures as FX
from .registry import loader, query
from .sqlfrag import lit, strip_ws, word_count, words

W = FX.with_ctes

# ---------------------------------------------------------------- E1 E3 E5
@query("pair_cosine", W(FX.PAIR_SCORES_SQL) +
       "SELECT vec_id, round(similarity, 6) AS similarity FROM pair_scores")
def pair_cosine(spark, d):
    return FX.pair_scores(loader(spark, d)).select("vec_id", F.round("similarity", 6).alias("similarity"))


RANK_SQL = """, ranked AS (
  SELECT *, CAST(row_number() OVER (ORDER BY CASE WHEN isnan(similarity) THEN NULL ELSE similarity END
                                    DESC NULLS LAST, id) - 1 AS BIGINT) AS rank FROM scored)"""


@query("rank_by_score", W(FX.SCORED_SQL + RANK_SQL) + "SELECT id, round(similarity, 6) AS similarity, rank FROM ranked")
def rank_by_score(spark, d):
    s = FX.scored_prompts(loader(spark, d))
    r = R.with_positions(s, S.rank_order("similarity", "id"), name="rank")
    return r.select("id", F.round("similarity", 6).alias("similarity"), "rank")


@query("ratio_split", W(FX.SCORED_SQL + RANK_SQL) + """
SELECT id, rank, CASE WHEN rank < floor((SELECT count(*) FROM ranked) * CAST(0.8 AS DOUBLE))
                      THEN 'train' ELSE 'test' END AS split
FROM ranked""")
def ratio_split(spark, d):
    s = FX.scored_prompts(loader(spark, d))
    return R.ratio_split(s, S.rank_order("similarity", "id"), 0.8, pos="rank").select("id", "rank", "split")


@query("split_by_threshold", W(FX.SCORED_SQL + RANK_SQL) + """
SELECT id, CASE WHEN rank < floor((SELECT count(*) FROM ranked) * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split
FROM ranked""")
def split_by_threshold(spark, d):
    """The split of the ranking by its one cutting key: no row is ranked."""
    s = FX.scored_prompts(loader(spark, d)).select("id", "similarity")
    return SEL.split_by_threshold(s, S.rank_order("similarity", "id"), 0.8).select("id", "split")


@query("sample_by_threshold", W(FX.PROMPTS_SQL) + """
SELECT id FROM (SELECT id, row_number() OVER (ORDER BY md5('0:' || CAST(id AS VARCHAR)), id) - 1 AS pos,
                       count(*) OVER () AS n FROM prompts) WHERE pos < floor(n * CAST(0.25 AS DOUBLE))""")
def sample_by_threshold(spark, d):
    return SEL.sample_by_threshold(FX.prompts(loader(spark, d)).select("id"), "id", 0.25)


# ---------------------------------------------------------------- B3 B5 C1 A4
@query("min_token_filter", W(FX.PROMPTS_SQL) + f"""
SELECT id, n_tokens FROM (SELECT id, {word_count('prompt')} AS n_tokens FROM prompts) WHERE n_tokens >= 55""")
def min_token_filter(spark, d):
    return X.min_token_filter(FX.prompts(loader(spark, d))).select("id", "n_tokens")


TRUNC_SQL = f"""filtered AS (
  SELECT *, {strip_ws(f"array_to_string(list_slice({words('prompt')}, 1, 77), ' ')")} AS truncated
  FROM prompts WHERE {word_count('prompt')} >= 55)"""


@query("truncate_tokens", W(FX.PROMPTS_SQL, TRUNC_SQL) + "SELECT id, truncated FROM filtered")
def truncate_tokens(spark, d):
    p = X.min_token_filter(FX.prompts(loader(spark, d)), out=None)
    return p.select("id", X.truncate_tokens("prompt").alias("truncated"))


@query("truncate_any_tokenizer", W(FX.PROMPTS_SQL, TRUNC_SQL) + "SELECT id, truncated FROM filtered")
def truncate_any_tokenizer(spark, d):
    """The path of a tokenizer that is passed in: filter and cut by its
    tokens, not by leading words."""
    mine = lambda c: T.words(c)
    p = X.min_token_filter(FX.prompts(loader(spark, d)), tokenizer=mine, out=None)
    return p.select("id", X.truncate_tokens("prompt", tokenizer=mine).alias("truncated"))


# ---------------------------------------------------------------- B3 B5 with subword tokens
def vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@query("subword_counts")
def subword_counts(spark, d):
    """Subword tokens of every prompt (no SQL: tests compare with a tokenizer)."""
    return SW.subword_counts(FX.prompts(loader(spark, d)), vocabulary())


@query("subword_truncate")
def subword_truncate(spark, d):
    """Prompts of at least 55 subword tokens, cut to their first 77."""
    return SW.truncate_subwords(FX.prompts(loader(spark, d)).select("id", "prompt"), vocabulary()).select("id", "truncated")


@query("subword_ids")
def subword_ids(spark, d):
    return SW.subword_ids(FX.prompts(loader(spark, d)), vocabulary())


def _training(spark, d):
    p = X.min_token_filter(FX.prompts(loader(spark, d)), out=None)
    return p.select("id", C.training_conversation("url", "prompt", X.truncate_tokens("prompt")).alias("conv"))


@query("build_conversation", W(FX.PROMPTS_SQL, TRUNC_SQL) + f"""
SELECT id, CAST(3 AS BIGINT) AS n_turns, CAST(length({lit(TRAIN_SYSTEM_MESSAGE)}) AS BIGINT) AS system_chars,
       url AS image, 'Original Prompt: ''' || prompt || '''' AS user_text,
       'Enhanced Prompt: ''' || truncated || '''' AS assistant_text
FROM filtered""")
def build_conversation(spark, d):
    c = _training(spark, d)
    conv = F.col("conv")
    return c.select("id", F.size(conv).cast("bigint").alias("n_turns"),
                    F.length(conv[0]["content"][0]["text"]).cast("bigint").alias("system_chars"),
                    conv[1]["content"][0]["image"].alias("image"),
                    conv[1]["content"][1]["text"].alias("user_text"),
                    conv[2]["content"][0]["text"].alias("assistant_text"))


@query("conversation_json", W(FX.PROMPTS_SQL, TRUNC_SQL) + f"""
SELECT id, '[{{"role":"system","content":[{{"type":"text","text":' || to_json({lit(TRAIN_SYSTEM_MESSAGE)})
  || '}}]}},{{"role":"user","content":[{{"type":"image","image":' || to_json(url)
  || '}},{{"type":"text","text":' || to_json('Original Prompt: ''' || prompt || '''')
  || '}}]}},{{"role":"assistant","content":[{{"type":"text","text":'
  || to_json('Enhanced Prompt: ''' || truncated || '''') || '}}]}}]' AS json
FROM filtered""")
def conversation_json(spark, d):
    return _training(spark, d).select("id", C.to_jsonl("conv").alias("json"))


# ---------------------------------------------------------------- B1 B2
@query("head_n", W(FX.PROMPTS_SQL) + "SELECT id, url FROM prompts ORDER BY id LIMIT 100")
def head_n(spark, d):
    return R.head_n(FX.prompts(loader(spark, d)), 100, ["id"]).select("id", "url")


@query("row_range", W(FX.PROMPTS_SQL) + """
SELECT id, pos FROM (SELECT id, CAST(row_number() OVER (ORDER BY id) - 1 AS BIGINT) AS pos FROM prompts)
WHERE pos >= 100 AND pos < 350""")
def row_range(spark, d):
    return R.row_range(FX.prompts(loader(spark, d)), 100, 350, ["id"]).select("id", "pos")


# ---------------------------------------------------------------- B4 B6 B7 B8 B9 B10
EXTRACT_SQL = f"""extracted AS (
  SELECT id, response,
         trim({strip_ws("string_split(response, 'Enhanced Prompt:')[-1]")}, '"') AS enhanced_prompt
  FROM responses WHERE contains(response, 'Enhanced Prompt:'))"""


@query("extract_marker", W(FX.RESPONSES_SQL, EXTRACT_SQL) + "SELECT id, enhanced_prompt FROM extracted")
def extract_marker(spark, d):
    return X.extract_enhanced(FX.responses(loader(spark, d))).select("id", "enhanced_prompt")


@query("min_word_filter", W(FX.RESPONSES_SQL, EXTRACT_SQL) + f"""
SELECT id, n_words FROM (SELECT id, {word_count('enhanced_prompt')} AS n_words FROM extracted)
WHERE n_words >= 25""")
def min_word_filter(spark, d):
    e = X.extract_enhanced(FX.responses(loader(spark, d)))
    return X.min_word_filter(e, "enhanced_prompt").select("id", "n_words")


@query("normalize_ws", W(FX.PROMPTS_SQL) + f"""
SELECT id, array_to_string({words('prompt')}, ' ') AS original_prompt FROM prompts""")
def normalize_ws(spark, d):
    return FX.prompts(loader(spark, d)).select("id", T.normalize_ws("prompt").alias("original_prompt"))


V2_COLUMNS = ["id", "url", "width", "height", "source_site", "similarity", "original_prompt",
              "enhanced_prompt"]


@query("project_defaults", W(FX.PROMPTS_SQL, FX.RESPONSES_SQL, EXTRACT_SQL) + f"""
SELECT p.id, p.url, p.width, p.height, p.source_site, '' AS similarity,
       array_to_string({words('p.prompt')}, ' ') AS original_prompt, e.enhanced_prompt
FROM prompts p JOIN extracted e ON e.id = p.id
WHERE {word_count('e.enhanced_prompt')} >= 25""")
def project_defaults(spark, d):
    """Enhanced-prompt rows from the unscored prompt table: ``similarity``
    is absent from the input and takes the default."""
    t = loader(spark, d)
    p = FX.prompts(t).withColumn("original_prompt", T.normalize_ws("prompt"))
    e = X.min_word_filter(X.extract_enhanced(FX.responses(t)), "enhanced_prompt")
    return X.project_with_defaults(p.join(e.select("id", "enhanced_prompt"), "id"), V2_COLUMNS)


@query("drop_failed", W(FX.PROMPTS_SQL, FX.PAIR_SCORES_SQL) + """
SELECT p.id, round(s.similarity, 6) AS similarity
FROM prompts p LEFT JOIN pair_scores s ON s.vec_id = p.id WHERE s.similarity IS NOT NULL""")
def drop_failed(spark, d):
    t = loader(spark, d)
    s = FX.pair_scores(t).withColumnRenamed("vec_id", "id")
    j = FX.prompts(t).join(s, "id", "left")
    return X.drop_failed(j, "similarity").select("id", F.round("similarity", 6).alias("similarity"))


@query("run_summary", W(FX.RESPONSES_SQL, EXTRACT_SQL) + f"""
SELECT (SELECT count(*) FROM responses) AS intended,
       CAST(count(*) AS BIGINT) AS succeeded FROM extracted WHERE {word_count('enhanced_prompt')} >= 25""")
def run_summary(spark, d):
    r = FX.responses(loader(spark, d)).withColumn("enhanced_prompt", X.extract_marker("response"))
    ok = F.col("enhanced_prompt").isNotNull() & (T.word_count("enhanced_prompt") >= 25)
    return X.run_summary(r, ok)


@query("run_summary_written", W(FX.RESPONSES_SQL, EXTRACT_SQL) + f"""
SELECT (SELECT count(*) FROM responses) AS intended, CAST(count(*) AS BIGINT) AS succeeded,
       CAST(count(*) AS BIGINT) AS written FROM extracted WHERE {word_count('enhanced_prompt')} >= 25""")
def run_summary_written(spark, d):
    """The summary of a run that writes its enhanced prompts: counted on the
    way to the file, beside the rows that the file has."""
    r = FX.responses(loader(spark, d)).withColumn("enhanced_prompt", X.extract_marker("response"))
    path = scratch_path(spark, "enhanced")
    got = X.observed_summary(r, T.word_count("enhanced_prompt") >= 25, lambda x: x.select("id", "enhanced_prompt").write.parquet(path))
    return spark.createDataFrame([(got["intended"], got["succeeded"], spark.read.parquet(path).count())],
                                 "intended long, succeeded long, written long")


# ---------------------------------------------------------------- E6 E7 E8 H1 C19
SPEC_SQL = """specs AS (
  SELECT doc_id AS id, source || CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN '%0' WHEN 2 THEN '%25'
                                  WHEN 3 THEN '%100' ELSE '%150' END AS spec
  FROM documents)"""


def _specs(t):
    k = F.col("doc_id") % 5
    suffix = (F.when(k == 0, "").when(k == 1, "%0").when(k == 2, "%25").when(k == 3, "%100")
              .otherwise("%150"))
    return t("documents").select(F.col("doc_id").alias("id"), F.concat("source", suffix).alias("spec"))


@query("sampling_rate", W(SPEC_SQL) + r"""
SELECT id, spec, regexp_replace(spec, '%(\d+)$', '') AS name,
       CASE WHEN regexp_extract(spec, '%(\d+)$', 1) = '' THEN 1.0
            ELSE CAST(regexp_extract(spec, '%(\d+)$', 1) AS BIGINT) / 100.0 END::DOUBLE AS rate
FROM specs""")
def sampling_rate(spark, d):
    from ..sources.registry import rate_of, strip_rate
    s = _specs(loader(spark, d))
    return s.select("id", "spec", strip_rate("spec").alias("name"), rate_of("spec").alias("rate"))


@query("shuffle_seeded", W(FX.PROMPTS_SQL) + """
SELECT id, CAST(row_number() OVER (ORDER BY md5('0:' || CAST(id AS VARCHAR)), id) - 1 AS BIGINT) AS pos
FROM prompts""")
def shuffle_seeded(spark, d):
    return R.shuffle_seeded(FX.prompts(loader(spark, d)), "id", seed=0).select("id", "pos")


@query("sample_exact", W(FX.PROMPTS_SQL) + """
SELECT id, source_site, pos FROM (
  SELECT id, source_site,
         CAST(row_number() OVER (PARTITION BY source_site ORDER BY md5('0:' || CAST(id AS VARCHAR)), id) - 1
              AS BIGINT) AS pos,
         count(*) OVER (PARTITION BY source_site) AS n
  FROM prompts) WHERE pos < floor(n * CAST(0.25 AS DOUBLE))""")
def sample_exact(spark, d):
    p = FX.prompts(loader(spark, d))
    return R.sample_exact(p, "id", 0.25, by=["source_site"], seed=0).select("id", "source_site", "pos")


@query("batch_assign", W(FX.PROMPTS_SQL) + """
SELECT id, pos, CAST(floor(pos / 64) AS BIGINT) AS batch FROM (
  SELECT id, CAST(row_number() OVER (ORDER BY md5('0:' || CAST(id AS VARCHAR)), id) - 1 AS BIGINT) AS pos
  FROM prompts)""")
def batch_assign(spark, d):
    p = FX.prompts(loader(spark, d)).withColumn("_k", R.seeded_key("id", 0))
    return R.batch_assign(p, 64, ["_k", "id"]).select("id", "pos", "batch")


@query("fallback_next", W(FX.PROMPTS_SQL) + """
SELECT id, pos, coalesce(lead(id) OVER (ORDER BY pos), id) AS fallback FROM (
  SELECT id, CAST(row_number() OVER (ORDER BY id) - 1 AS BIGINT) AS pos FROM prompts)""")
def fallback_next(spark, d):
    p = R.with_positions(FX.prompts(loader(spark, d)), ["id"])
    return R.next_row_fallback(p, "id").select("id", "pos", "fallback")


@query("fallback_failed", W(FX.PROMPTS_SQL) + """
SELECT id, pos, CASE WHEN id % 7 NOT IN (0, 1) THEN id WHEN NOT coalesce(nf, true) THEN nid END AS used FROM (
  SELECT id, CAST(row_number() OVER (ORDER BY id) - 1 AS BIGINT) AS pos, lead(id) OVER (ORDER BY id) AS nid,
         lead(id % 7 IN (0, 1)) OVER (ORDER BY id) AS nf FROM prompts)""")
def fallback_failed(spark, d):
    """Failed samples (two in seven, side by side) take the next one."""
    p = R.with_positions(FX.prompts(loader(spark, d)), ["id"]).withColumn("bad", F.col("id") % 7 < 2)
    return R.next_row_fallback(p, "id", name="used", failed="bad").select("id", "pos", "used")


# ---------------------------------------------------------------- flagship
@query("curate_split_convert", W(FX.SCORED_SQL + RANK_SQL) + f""",
split AS (SELECT *, CASE WHEN rank < floor((SELECT count(*) FROM ranked) * CAST(0.8 AS DOUBLE))
                         THEN 'train' ELSE 'test' END AS split FROM ranked),
{TRUNC_SQL.replace("FROM prompts", "FROM split")}
SELECT id, split, rank, '[{{"role":"system","content":[{{"type":"text","text":' || to_json({lit(TRAIN_SYSTEM_MESSAGE)})
  || '}}]}},{{"role":"user","content":[{{"type":"image","image":' || to_json(url)
  || '}},{{"type":"text","text":' || to_json('Original Prompt: ''' || prompt || '''')
  || '}}]}},{{"role":"assistant","content":[{{"type":"text","text":'
  || to_json('Enhanced Prompt: ''' || truncated || '''') || '}}]}}]' AS json
FROM filtered""")
def flagship(spark, d):
    """Score (E1) -> rank (E3) -> 80/20 split (E5) -> >= 55 tokens (B3) ->
    truncate to 77 (B5) -> training conversation (C1) -> JSONL text (A4)."""
    s = FX.scored_prompts(loader(spark, d))
    sp = R.ratio_split(s, S.rank_order("similarity", "id"), 0.8, pos="rank")
    f = X.min_token_filter(sp, out=None)
    conv = C.training_conversation("url", "prompt", X.truncate_tokens("prompt"))
    return f.select("id", "split", "rank", C.to_jsonl(conv).alias("json"))
