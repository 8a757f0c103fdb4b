"""Line dedup: lines that stand in many documents go from every document.

A line's key is the line without blanks ``[\\x20\\x09-\\x0D]`` at both ends,
A-Z lower-cased.  The keys of a text become an array of hashes, one for each
line, in a saved narrow table; everything up to the last step works on that
table, not on texts:

 1. explode the distinct hashes of each document and count documents per hash
    (partial counts before the shuffle, so a line that stands everywhere costs
    one row for each task);
 2. explode the hashes with their positions and join the frequent ones; what
    is left are the positions that go, gathered per document;
 3. one join brings the positions back to the texts, whose remaining lines are
    put together from the gaps between them.

DataFrame and SQL functions only.  A document is found again by its id and the
hash of its text, so nothing depends on row order and a lost task can run again.
Keys and texts are told apart by 64-bit hashes.

Defined results: a null or empty text is one empty line; a key shorter than
``min_chars`` code points (so any blank line, by default) stays; every row is a
document, so repeated rows count each and lose the same lines; a null doc_id is
an id like others; extra columns are carried through, and a column of the input
with the name of an added one is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import saved

MIN_DOCS, MIN_CHARS = 10, 1
ADDED = ["n_lines", "n_dropped", "kept_text"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = "decode(unhex('20090A0B0C0D'), 'US-ASCII')"

#: a line in ASCII is lower-cased as a whole, which is much faster than letter by letter
KEY = (f"btrim(CASE WHEN octet_length(x) = char_length(x) THEN lower(x) ELSE translate(x, '{UPPER}', '{LOWER}') END, "
       f"{BLANKS})")


def key_hashes(text: str, min_chars: int) -> str:
    """SQL: for each line of ``text`` the hash of its key, null where the key is too short."""
    key = f"transform(split({text}, '\\n'), x -> {KEY})"
    return f"transform({key}, k -> CASE WHEN char_length(k) >= {int(min_chars)} THEN xxhash64(k) END)"


#: lines that remain: the gaps before, between and after the dropped positions (sorted, from 0)
KEPT = """
flatten(transform(sequence(0, size(_gone)), j -> slice(_l,
  CASE WHEN j = 0 THEN 1 ELSE _gone[j - 1] + 2 END,
  CASE WHEN j = size(_gone) THEN size(_l) ELSE _gone[j] END - CASE WHEN j = 0 THEN 0 ELSE _gone[j - 1] + 1 END)))
"""


def drop_common_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_docs: int = MIN_DOCS,
                      min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with ``n_lines`` (before dropping), ``n_dropped`` and ``kept_text``."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rest = [c for c in docs.columns if c not in ADDED]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_row"),
                       F.col(f"`{doc_id}`").alias("_id"), body.alias("_text")).withColumn("_t", F.xxhash64("_text"))
    keys = saved(rows.select("_id", "_t", F.expr(key_hashes("_text", min_chars)).alias("_keys")), "line-keys")
    # saved, so that its size is known and a line that stands everywhere can be split in the join
    common = saved(keys.select(F.explode(F.array_distinct("_keys")).alias("_key")).filter("_key IS NOT NULL")
                   .groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_docs).select("_key"),
                   "common-lines")
    gone = (keys.select("_id", "_t", F.posexplode("_keys").alias("_pos", "_key")).filter("_key IS NOT NULL")
            .join(common, "_key")
            .groupBy(F.col("_id").alias("_gid"), F.col("_t").alias("_gt"))
            .agg(F.sort_array(F.collect_set("_pos")).alias("_gone")))       # bounded by the lines of one text
    joined = rows.join(gone, F.col("_t").eqNullSafe(F.col("_gt")) & F.col("_id").eqNullSafe(F.col("_gid")), "left")
    return joined.withColumn("_l", F.split("_text", "\n")).select(
        "_row.*", F.size("_l").cast("long").alias("n_lines"),
        F.when(F.col("_gone").isNull(), F.lit(0)).otherwise(F.size("_gone")).cast("long").alias("n_dropped"),
        F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(F.array_join(F.expr(KEPT), "\n")).alias("kept_text"))


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (
  SELECT rid, doc_id, i, l[i] AS line,
         regexp_replace(regexp_replace(translate(l[i], '{UPPER}', '{LOWER}'),
                        '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS k
  FROM (SELECT rid, doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d)),
common AS (SELECT k FROM x WHERE length(k) >= {MIN_CHARS} GROUP BY k HAVING count(DISTINCT rid) >= {MIN_DOCS})
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(c.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE c.k IS NULL), '')) AS kept_sha256
FROM x LEFT JOIN common c USING (k) GROUP BY rid"""


def op13_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_common_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
