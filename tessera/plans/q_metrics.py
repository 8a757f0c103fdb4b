"""Registered queries: evaluation metrics over the embeddings table (F1-F8).

Sides: even labels are the real/original side, odd labels the generated
side.  Logits are the embedding scaled by 10 (features enter as columns;
the networks that produce them stay outside).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import factor as FA
from ..operators import metrics as M
from . import fixtures as FX
from .registry import loader, query

W = FX.with_ctes
SCALE = 10.0
SIDE_SQL = "CASE WHEN label % 2 = 0 THEN 'real' ELSE 'generated' END"


def _side():
    return F.when(F.col("label") % 2 == 0, "real").otherwise("generated")


def _emb(spark, d):
    return loader(spark, d)("embeddings").withColumn("side", _side())


def probs_sql(src: str, vec: str, keep: str) -> str:
    return f"""sm AS (SELECT {keep}, list_transform(z, lambda x: exp(x - list_max(z))) AS ex
           FROM (SELECT {keep}, list_transform({vec}::DOUBLE[], lambda x: x * {SCALE}) AS z FROM {src})),
probs AS (SELECT {keep}, list_transform(ex, lambda x: x / list_sum(ex)) AS p FROM sm)"""


@query("softmax_rows", W(probs_sql("embeddings", "embedding", "vec_id")) + """
SELECT vec_id, dim, round(p, 10) AS p FROM (
  SELECT vec_id, CAST(generate_subscripts(p, 1) - 1 AS BIGINT) AS dim, unnest(p) AS p FROM probs)""")
def softmax_rows(spark, d):
    e = loader(spark, d)("embeddings").select("vec_id", V.softmax("embedding", SCALE).alias("p"))
    x = e.select("vec_id", F.posexplode("p").alias("dim", "p"))
    return x.select("vec_id", F.col("dim").cast("bigint"), F.round("p", 10).alias("p"))


@query("mean_vector", f"""
SELECT side, dim, round(avg(x), 10) AS mean FROM (
  SELECT {SIDE_SQL} AS side, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS dim,
         unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY side, dim""")
def mean_vector(spark, d):
    m = M.mean_vector(_emb(spark, d), "embedding", ["side"])
    return m.select("side", F.col("dim").cast("bigint"), F.round("mean", 10).alias("mean"))


@query("covariance_long", f"""
WITH ex AS (SELECT vec_id, {SIDE_SQL} AS side, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS i,
                   unnest(embedding::DOUBLE[]) AS x FROM embeddings)
SELECT a.side, a.i, b.i AS j, round(covar_samp(a.x, b.x), 10) AS cov
FROM ex a JOIN ex b ON a.vec_id = b.vec_id GROUP BY a.side, a.i, b.i""")
def covariance_long(spark, d):
    c = M.covariance_long(_emb(spark, d), "embedding", ["side"])
    return c.select("side", F.col("i").cast("bigint"), F.col("j").cast("bigint"), F.round("cov", 10).alias("cov"))


@query("frechet_distance")
def frechet_distance(spark, d):
    """Fréchet distance real vs generated (rows check; numpy cross-check
    in tests)."""
    fid = FA.frechet_distance(_emb(spark, d), "embedding", "side", "real", "generated")
    return spark.createDataFrame([(round(fid, 9),)], "frechet_distance double")


C_GEN, B_GEN = 1.5, 0.25


@query("frechet_affine", f"""
WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings),
m AS (SELECT i, avg(x) AS mu, var_samp(x) AS v FROM x GROUP BY i)
SELECT round(sum(power(mu * (1 - {C_GEN}) - {B_GEN}, 2) + power(1 - {C_GEN}, 2) * v), 6) AS frechet_distance FROM m""")
def frechet_affine(spark, d):
    """Fréchet distance of the vectors to c * vector + b: there the matrix
    root has a closed form, |mu1 - mu2|^2 + (1 - c)^2 tr(S1)."""
    e = loader(spark, d)("embeddings")
    moved = F.transform("embedding", lambda x: x.cast("double") * C_GEN + B_GEN)
    both = e.select(F.lit("real").alias("side"), V._d("embedding").alias("v")).unionByName(
        e.select(F.lit("generated").alias("side"), moved.alias("v")))
    fid = FA.frechet_distance(both, "v", "side", "real", "generated")
    return spark.createDataFrame([(round(fid, 6),)], "frechet_distance double")


def _is_sql(src: str) -> str:
    return f""",
rowh AS (SELECT side, CAST(count(*) AS BIGINT) AS n,
                avg(list_sum(list_transform(p, lambda x: x * ln(x + 1e-16)))) AS h_row FROM {src} GROUP BY side),
pb AS (SELECT side, i, avg(x) AS pbar FROM (
         SELECT side, generate_subscripts(p, 1) AS i, unnest(p) AS x FROM {src}) GROUP BY side, i),
hb AS (SELECT side, sum(pbar * ln(pbar + 1e-16)) AS h_bar FROM pb GROUP BY side),
iscore AS (SELECT r.side, r.n, exp(h_row - h_bar) AS inception_score FROM rowh r JOIN hb USING (side))"""


@query("inception_score", W(f"emb AS (SELECT vec_id, {SIDE_SQL} AS side, embedding FROM embeddings)",
                            probs_sql("emb", "embedding", "vec_id, side")) + _is_sql("probs")[0:] + """
SELECT side, n, round(inception_score, 9) AS inception_score FROM iscore""")
def inception_score(spark, d):
    e = _emb(spark, d).withColumn("p", V.softmax("embedding", SCALE))
    s = M.inception_score(e, "p", ["side"])
    return s.select("side", "n", F.round("inception_score", 9).alias("inception_score"))


@query("l2_normalize", """
SELECT vec_id, dim, round(x, 10) AS x FROM (
  SELECT vec_id, CAST(generate_subscripts(v, 1) - 1 AS BIGINT) AS dim,
         unnest(list_transform(v, lambda y: y / sqrt(list_sum(list_transform(v, lambda z: z * z))))) AS x
  FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings))""")
def l2_normalize(spark, d):
    e = loader(spark, d)("embeddings").select("vec_id", V.l2_normalize("embedding").alias("v"))
    x = e.select("vec_id", F.posexplode("v").alias("dim", "x"))
    return x.select("vec_id", F.col("dim").cast("bigint"), F.round("x", 10).alias("x"))


def _l2(v: str) -> str:
    return f"list_transform({v}::DOUBLE[], lambda y: y / sqrt(list_sum(list_transform({v}::DOUBLE[], lambda z: z * z))))"


@query("clip_score", f"""
SELECT side, CAST(count(*) AS BIGINT) AS n_pairs,
       round(avg(greatest(list_dot_product({_l2('a.embedding')}, {_l2('b.embedding')}), 0.0)) * 2.5, 9) AS clip_score
FROM (SELECT *, {SIDE_SQL} AS side FROM embeddings) a JOIN embeddings b ON b.vec_id = a.vec_id + 1
GROUP BY side""")
def clip_score(spark, d):
    e = _emb(spark, d)
    txt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("txt"))
    pairs = e.select("vec_id", "side", F.col("embedding").alias("img")).join(txt, "vec_id")
    c = M.clip_score(pairs, "img", "txt", ["side"])
    return c.select("side", "n_pairs", F.round("clip_score", 9).alias("clip_score"))


def aligned(spark, d):
    """Original and generated images aligned by row index r = vec_id div 2
    (full outer join).  An original with label 9 failed to download, a
    generated with label 0 was not produced; the prompt's text feature is
    the row's even vector."""
    e = loader(spark, d)("embeddings").withColumn("r", F.floor(F.col("vec_id") / 2))
    o = e.filter(F.col("vec_id") % 2 == 0).select(
        "r", F.when(F.col("label") != 9, F.col("embedding")).alias("o_vec"), F.col("embedding").alias("txt"))
    g = e.filter(F.col("vec_id") % 2 == 1).select(
        "r", F.when(F.col("label") != 0, F.col("embedding")).alias("g_vec"))
    return o.join(g, "r", "full_outer")


@query("eval_report", W(
    "e AS (SELECT vec_id // 2 AS r, vec_id % 2 AS odd, label, embedding FROM embeddings)",
    "o AS (SELECT r, CASE WHEN label <> 9 THEN embedding END AS o_vec, embedding AS txt FROM e WHERE odd = 0)",
    "g AS (SELECT r, CASE WHEN label <> 0 THEN embedding END AS g_vec FROM e WHERE odd = 1)",
    "al AS (SELECT coalesce(o.r, g.r) AS r, o_vec, g_vec, txt FROM o FULL OUTER JOIN g ON o.r = g.r)",
    """sides AS (SELECT 'original' AS side, r, o_vec AS vec, NULL::FLOAT[] AS txt FROM al WHERE o_vec IS NOT NULL
          UNION ALL SELECT 'generated', r, g_vec, txt FROM al WHERE g_vec IS NOT NULL)""",
    probs_sql("sides", "vec", "r, side, vec, txt")) + _is_sql("probs") + f""",
clip AS (SELECT side, avg(greatest(list_dot_product({_l2('vec')}, {_l2('txt')}), 0.0)) * 2.5 AS clip_score
         FROM sides WHERE side = 'generated' AND txt IS NOT NULL GROUP BY side)
SELECT i.side, i.n, round(i.inception_score, 9) AS inception_score, round(c.clip_score, 9) AS clip_score
FROM iscore i LEFT JOIN clip c USING (side)""")
def eval_report(spark, d):
    a = aligned(spark, d)
    orig = a.filter(F.col("o_vec").isNotNull()).select(
        F.lit("original").alias("side"), F.col("o_vec").alias("vec"), F.lit(None).cast("array<float>").alias("txt"))
    gen = a.filter(F.col("g_vec").isNotNull()).select(
        F.lit("generated").alias("side"), F.col("g_vec").alias("vec"), "txt")
    s = orig.unionByName(gen).withColumn("p", V.softmax("vec", SCALE))
    return M.report(s, "p", "vec", "txt", ["side"]).select(
        "side", "n", F.round("inception_score", 9).alias("inception_score"),
        F.round("clip_score", 9).alias("clip_score"))
