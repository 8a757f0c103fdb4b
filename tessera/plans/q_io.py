"""Registered queries: media references, payloads, fetch ledger and cache,
model scoring hook and streaming ingest (A6-A12, E2, I1-I5)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import score as S
from ..session import scratch_path
from ..sources import fetch as FE
from ..sources import files as SRC
from ..streaming import ingest as ST
from ..streaming.counters import Totals
from . import fixtures as FX
from .registry import loader, query

W = FX.with_ctes


def refs(t):
    """Media references of four kinds derived from the pages table."""
    p = t("pages")
    k = F.col("page_id") % 4
    pid = F.col("page_id").cast("string")
    ref = (F.when(k == 0, F.col("url"))
           .when(k == 1, F.concat(F.lit("file:///data/media/"), pid, F.lit(".jpg")))
           .when(k == 2, F.concat(F.lit("data:image/png;base64,"),
                                  SRC.base64_text(F.encode(F.col("html"), "UTF-8"))))
           .otherwise(F.concat(F.lit("media/"), pid, F.lit(".webp"))))
    return p.select("page_id", ref.alias("ref"))


REFS_SQL = """refs AS (
  SELECT page_id, CASE page_id % 4 WHEN 0 THEN url
                    WHEN 1 THEN 'file:///data/media/' || CAST(page_id AS VARCHAR) || '.jpg'
                    WHEN 2 THEN 'data:image/png;base64,' || to_base64(encode(html))
                    ELSE 'media/' || CAST(page_id AS VARCHAR) || '.webp' END AS ref
  FROM pages),
cls AS (
  SELECT *, CASE WHEN starts_with(ref, 'http://') OR starts_with(ref, 'https://') THEN 'http'
                 WHEN starts_with(ref, 'file://') THEN 'file'
                 WHEN starts_with(ref, 'data:image') AND contains(ref, 'base64,') THEN 'data'
                 ELSE 'path' END AS scheme
  FROM refs)"""


@query("media_refs", W(REFS_SQL) + r"""
SELECT page_id, scheme,
       CASE WHEN starts_with(ref, 'file://') THEN substr(ref, 8) WHEN scheme = 'path' THEN ref END AS local_path,
       coalesce(nullif(regexp_extract(regexp_replace(regexp_extract(split_part(ref, '?', 1), '[^/]*$', 0),
                                                     '^\.+', ''), '(\.[^.]*)$', 1), ''), '.png') AS ext,
       CASE WHEN scheme = 'data' THEN CAST(octet_length(from_base64(split_part(ref, 'base64,', 2))) AS BIGINT) END
         AS payload_len
FROM cls""")
def media_refs(spark, d):
    r = refs(loader(spark, d))
    return r.select("page_id", SRC.media_scheme("ref").alias("scheme"), SRC.media_local_path("ref").alias("local_path"),
                    SRC.url_ext("ref").alias("ext"),
                    F.length(SRC.data_uri_payload("ref")).cast("bigint").alias("payload_len"))


@query("prompt_csv", W(FX.PROMPTS_SQL) + """
SELECT p.id, nullif(p.prompt, '') AS prompt, p.url, p.width, p.height, p.source_site, d.lang,
       CASE WHEN p.id % 5 = 0 THEN 'test' ELSE 'train' END AS split
FROM prompts p JOIN documents d ON d.doc_id = p.id""")
def prompt_csv(spark, d):
    """Prompts written as CSV, one folder per split, with columns in another
    order and one more, and read back by header."""
    t = loader(spark, d)
    x = FX.prompts(t).join(t("documents").select(F.col("doc_id").alias("id"), "lang"), "id")
    x = x.withColumn("split", F.when(F.col("id") % 5 == 0, "test").otherwise("train"))
    path = scratch_path(spark, "prompt-csv")
    SRC.write_csv(x.select("url", "lang", "prompt", "id", "height", "width", "source_site", "split"), path)
    return SRC.read_prompt_csv(spark, path)


def _media_folder(spark, pages, content):
    """Each page as one media file named by its number; a null ``content`` is
    no file.  The folder and the number of files."""
    path = scratch_path(spark, "media")
    name = F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(".txt"))
    return path, SRC.write_media(pages.select(name.alias("name"), content.cast("binary").alias("content")), path)


@query("media_listing", "SELECT page_id, octet_length(encode(html)) + 1 AS length FROM pages")
def media_listing(spark, d):
    """Files of a media folder (each page's html and a line end), known by
    their names; no file is opened.  A page without html has no file and no
    length."""
    p = loader(spark, d)("pages")
    body = F.concat("html", F.lit("\n"))
    number = F.regexp_extract("path", r"/\d+-(-?\d*)\.txt$", 1).try_cast("bigint").alias("page_id")
    folder, n = _media_folder(spark, p, body)
    files = SRC.media_listing(spark, folder, "*.txt", n).select(number, "length")
    return files.unionByName(p.filter(body.isNull()).select("page_id", F.lit(None).cast("bigint").alias("length")))


_FILE_SQL = "CAST(page_id AS VARCHAR) || chr(10) || html || chr(10)"


@query("media_payload", f"SELECT page_id, octet_length(encode({_FILE_SQL})) AS length, md5({_FILE_SQL}) AS content_md5 FROM pages")
def media_payload(spark, d):
    """Whole contents of the files of a media folder (each page's number, its
    html and a line end).  A page without either has no file, no length and no
    checksum."""
    p = loader(spark, d)("pages")
    body = F.concat(F.col("page_id").cast("string"), F.lit("\n"), "html", F.lit("\n"))
    first = F.substring_index(F.col("content").cast("string"), "\n", 1).cast("bigint")
    folder, n = _media_folder(spark, p, body)
    files = SRC.media_payloads(spark, folder, "*.txt", n).select(
        first.alias("page_id"), "length", F.md5("content").alias("content_md5"))
    return files.unionByName(p.filter(body.isNull()).select(
        "page_id", F.lit(None).cast("bigint").alias("length"), F.lit(None).cast("string").alias("content_md5")))


@query("payload_base64", """
SELECT page_id, CAST(length(b) AS BIGINT) AS b64_len, md5(b) AS b64_md5
FROM (SELECT page_id, to_base64(encode(html)) AS b FROM pages)""")
def payload_base64(spark, d):
    b = loader(spark, d)("pages").select("page_id", SRC.base64_text(F.encode("html", "UTF-8")).alias("b"))
    return b.select("page_id", F.length("b").cast("bigint").alias("b64_len"), F.md5("b").alias("b64_md5"))


@query("fetch_todo", W(FX.PROMPTS_SQL) + """
SELECT p.id, p.url FROM prompts p WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = p.id)""")
def fetch_todo(spark, d):
    t = loader(spark, d)
    done = t("labels").select(F.col("doc_id").alias("id"))
    return FE.fetch_todo(FX.prompts(t), done, "id").select("id", "url")


@query("fetch_todo_filtered", W(FX.PROMPTS_SQL) + """
SELECT p.id, p.url FROM prompts p WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = p.id)""")
def fetch_todo_filtered(spark, d):
    """The same behind a Bloom filter of the cache."""
    t = loader(spark, d)
    done = t("labels").select(F.col("doc_id").alias("id"))
    return FE.fetch_todo(FX.prompts(t).select("id", "url"), done, "id", by_filter=True)


# ---------------------------------------------------------------- E2
DIM = 64
_W = np.random.default_rng(7).standard_normal(DIM)
_W_SQL = "[" + ", ".join(repr(float(x)) for x in _W) + "]::DOUBLE[]"


@query("batch_score", f"""
SELECT vec_id, round(1.0 / (1.0 + exp(-list_dot_product(embedding::DOUBLE[], {_W_SQL}))), 6) AS score
FROM embeddings""")
def batch_score(spark, d):
    e = loader(spark, d)("embeddings")
    s = S.batch_score(e, S.projection_model(DIM, seed=7), "embedding", DIM, batch_size=64)
    return s.select("vec_id", F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- I1-I5
def _pairs(t):
    e = t("embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("txt"))
    return e.select("vec_id", "label", F.col("embedding").alias("img")).join(b, "vec_id")


def _score_stream(s):
    ok = F.col("label") != 9   # label 9 marks a failed download
    return s.select("vec_id", F.when(ok, "processed").otherwise("failed").alias("status"),
                    F.when(ok, F.round(V.cosine("img", "txt"), 6)).alias("similarity"))


#: least bound on the items in flight: rows of a micro-batch of pairs (the reference's limit) and of events
MAX_PENDING, EVENT_ROWS = 150, 5000


def in_flight(spark, src: str, least: int) -> int:
    """Rows that a micro-batch may hold: a quarter of what is staged (from the
    footers), ``least`` at least."""
    return max(least, spark.read.parquet(src).count() // 4)


@query("stream_score", """
SELECT a.vec_id, CASE WHEN a.label = 9 THEN 'failed' ELSE 'processed' END AS status,
       CASE WHEN a.label <> 9 THEN round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])
            / (greatest(sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])), 1e-8)
               * greatest(sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 1e-8)), 6) END
         AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def stream_score(spark, d):
    """Pairs arrive as files; a bounded number of rows is in flight;
    each micro-batch is scored and appended to the sink."""
    src_df = _pairs(loader(spark, d))
    src = ST.stage_files(src_df, "pairs-arrivals")
    sink, _ = ST.run_stream(spark, src, src_df.schema, _score_stream, name="score", max_rows=in_flight(spark, src, MAX_PENDING))
    return spark.read.parquet(sink).select("vec_id", "status", "similarity")


@query("stream_batches", f"""
WITH p AS (SELECT n, greatest({MAX_PENDING}, n // 4) AS m
           FROM (SELECT count(*) AS n FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1))
SELECT CAST(k AS INTEGER) AS batch, CAST(least(m, n - k * m) AS BIGINT) AS n
FROM (SELECT n, m, unnest(range(CAST(ceil(n / m) AS BIGINT))) AS k FROM p)""")
def stream_batches(spark, d):
    """Rows of every micro-batch: each holds the bound but the last, whatever
    the size of the files."""
    src_df = _pairs(loader(spark, d)).select("vec_id", "label")
    src = ST.stage_files(src_df, "pairs-bounded", file_rows=400)
    _, batches = ST.run_stream(spark, src, src_df.schema, lambda s: s, name="bounded",
                               max_rows=in_flight(spark, src, MAX_PENDING))
    return batches.select("batch", "n")


@query("stream_progress", """
SELECT CASE WHEN a.label = 9 THEN 'failed' ELSE 'processed' END AS status, CAST(count(*) AS BIGINT) AS n
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 GROUP BY 1
UNION ALL SELECT 'pending', CAST(0 AS BIGINT)""")
def stream_progress(spark, d):
    """Processed and failed rows, counted as they pass to the sink and summed
    by a listener over the micro-batches, plus pending = staged - both once
    the stream stops."""
    src_df = _pairs(loader(spark, d))
    src = ST.stage_files(src_df, "pairs-progress")
    totals = Totals("progress")

    def score(s):
        is_ = lambda k: F.count_if(F.col("status") == k).alias(k)
        return _score_stream(s).observe("progress", is_("processed"), is_("failed"))

    ST.run_stream(spark, src, src_df.schema, score, name="progress",
                  max_rows=in_flight(spark, src, MAX_PENDING), totals=totals)
    done = totals.wait()
    staged = spark.read.parquet(src).count()            # from the footers
    rows = [(k, n) for k, n in done.items() if n] + [("pending", staged - sum(done.values()))]
    return spark.createDataFrame(rows, "status string, n long")


@query("stream_dedup", f"""
SELECT user_id, event_id FROM (
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY batch, ts, event_id) AS k
  FROM (SELECT *, (row_number() OVER (ORDER BY event_id) - 1) // greatest({EVENT_ROWS}, count(*) OVER () // 4) AS batch
        FROM events))
WHERE k = 1""")
def stream_dedup(spark, d):
    """Skip-if-seen across arrivals: events arrive in the order of their ids;
    of every user the first micro-batch that has one admits its earliest
    event, and no later one does."""
    ev = loader(spark, d)("events").select("event_id", "user_id", "ts")
    src = ST.stage_files(ev, "event-arrivals", order=["event_id"])
    return ST.admit_first(spark, src, ev.schema, ["user_id"], ["ts", "event_id"], name="dedup",
                          max_rows=in_flight(spark, src, EVENT_ROWS)).select("user_id", "event_id")
