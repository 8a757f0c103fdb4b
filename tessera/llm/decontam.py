"""Benchmark decontamination: one Aho-Corasick automaton over the normalised
word windows of test items scans every text once.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z
lower-cased; a window is ``WINDOW`` consecutive words of an item (an item of
fewer words, but not none, is one window).  The automaton runs over word
numbers, not characters, so its size is at most ``WINDOW`` nodes per window.

Size bound: items are cut into blocks of at most ``BLOCK_WORDS`` words; each
block is one broadcast and one automaton, and a larger benchmark means more
passes over the text, never a larger broadcast.  Items reach the driver block
by block.  The documents are only scanned: no shuffle, and each row's result
depends on that row alone.

Defined results: a null or empty text has no words and no hits; a null or
wordless item has no window; a null ``item_id`` is written as the empty
string; repeated items count once per id; repeated documents are scanned each;
extra columns are carried through, and a column of the input with the name of
an added one is replaced; an empty benchmark leaves every text clean.
"""

from __future__ import annotations

import itertools
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import text_views

WINDOW = 10
BLOCK_WORDS = 500_000

#: byte -> lower-case word byte, or blank
_NORMAL = bytes((b + 32 if 65 <= b <= 90 else b) if (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
                else 32 for b in range(256))

ADDED = "n_words long, n_hit long, hit_spans array<struct<start:int,end:int>>, item_ids array<string>"


def item_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_NORMAL).split()


def windows(words: list, size: int = WINDOW) -> list[tuple]:
    """Windows of one item as tuples of words."""
    if len(words) < size:
        return [tuple(words)] if words else []
    return [tuple(words[i:i + size]) for i in range(len(words) - size + 1)]


def build(items: list[tuple[str, list[bytes]]], size: int = WINDOW):
    """(word -> number, automaton with window number at each end, window
    lengths, ids of each window)."""
    import ahocorasick

    numbers: dict[bytes, int] = {}
    found: dict[tuple, dict] = {}
    for item_id, ws in items:
        for w in windows([numbers.setdefault(x, len(numbers) + 1) for x in ws], size):
            found.setdefault(w, {})[item_id] = None
    auto = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    lengths, ids = [], []
    for k, (w, owners) in enumerate(found.items()):
        auto.add_word(w, k)
        lengths.append(len(w))
        ids.append(list(owners))
    if found:
        auto.make_automaton()
    return numbers, auto if found else None, lengths, ids


_BUILT: dict = {}


def scan(broadcast, text: str, size: int):
    """The mapInArrow function of one block of items."""
    def run(batches):
        key = broadcast.value["key"]
        if key not in _BUILT:
            _BUILT.clear()                       # one automaton per worker at a time
            _BUILT[key] = build(broadcast.value["items"], size)
        numbers, auto, lengths, ids = _BUILT[key]
        for batch in batches:
            raw, off = text_views(batch.column(text))
            n_words, n_hit, spans, items = [], [], [], []
            for k in range(batch.num_rows):
                doc = raw[off[k]:off[k + 1]].tobytes().translate(_NORMAL)
                ws = doc.split()
                n_words.append(len(ws))
                marked, owners = None, set()
                if auto is not None and ws:
                    for end, w in auto.iter(tuple(map(numbers.get, ws, itertools.repeat(0)))):
                        if marked is None:
                            marked = np.zeros(len(ws), bool)
                        marked[end + 1 - lengths[w]:end + 1] = True
                        owners.update(ids[w])
                n_hit.append(0 if marked is None else int(marked.sum()))
                spans.append([] if marked is None else _spans(doc, marked))
                items.append(sorted(owners))
            new = {"n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()),
                   "hit_spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                   "item_ids": pa.array(items, pa.list_(pa.string()))}
            keep = [c for c in batch.schema.names if c not in new]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + list(new.values()),
                                             names=keep + list(new))
    return run


def _spans(doc: bytes, marked: np.ndarray) -> list[dict]:
    """Byte ranges of the runs of marked words in the original text."""
    solid = np.frombuffer(doc, np.uint8) != 32
    step = np.diff(np.concatenate(([0], solid.view(np.int8), [0])))
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    run = np.diff(np.concatenate(([0], marked.view(np.int8), [0])))
    return [{"start": int(starts[a]), "end": int(ends[b - 1])}
            for a, b in zip(np.flatnonzero(run == 1), np.flatnonzero(run == -1))]


def item_blocks(benchmark: DataFrame, block_words: int):
    """Lists of (item id, words) of at most ``block_words`` words each."""
    block, n = [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), "text")
    for r in rows.distinct().orderBy("i", "text").toLocalIterator():
        ws = item_words(r["text"])
        if block and n + len(ws) > block_words:
            yield block
            block, n = [], 0
        block.append((r["i"], ws))
        n += len(ws)
    yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", size: int = WINDOW,
               block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit`` (words inside an occurring window),
    ``hit_spans`` (byte ranges in the original text) and ``item_ids``."""
    spark = docs.sparkSession
    added = ["n_words", "n_hit", "hit_spans", "item_ids"]
    out = docs.drop(*added)
    base = out.schema
    full = T.StructType(base.fields + T._parse_datatype_string(ADDED).fields)
    for k, block in enumerate(item_blocks(benchmark, block_words)):
        shared = spark.sparkContext.broadcast({"key": uuid.uuid4().hex, "items": block})
        if k == 0:
            out = out.mapInArrow(scan(shared, text, size), full)
            continue
        # a further block: scan again and merge with what the row has so far
        prior = T.StructType(base.fields + [T.StructField(f"_{f.name}", f.dataType) for f in full.fields[-3:]])
        so_far = out.drop("n_words").withColumnsRenamed({c: f"_{c}" for c in added[1:]})
        out = (so_far.mapInArrow(scan(shared, text, size), T.StructType(prior.fields + full.fields[-4:]))
               .withColumn("hit_spans", merge_spans(F.concat("_hit_spans", "hit_spans")))
               .withColumn("item_ids", F.array_sort(F.array_union("_item_ids", "item_ids")))
               .drop("_hit_spans", "_item_ids", "_n_hit"))
        out = out.mapInArrow(count_hits(text), out.schema).select(*full.fieldNames())
    return out


def merge_spans(spans):
    """Union of byte ranges, sorted; ranges that overlap or touch a shared
    word become one."""
    zero = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    return F.aggregate(F.array_sort(spans), zero, lambda acc, s: F.when(
        (F.size(acc) > 0) & (s["start"] <= F.element_at(acc, -1)["end"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1),
                 F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"),
                                  F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end")))))
        .otherwise(F.concat(acc, F.array(s))))


def count_hits(text: str):
    """Recount ``n_hit`` from merged spans."""
    def run(batches):
        for batch in batches:
            raw, off = text_views(batch.column(text))
            spans = batch.column("hit_spans").to_pylist()
            n = [sum(len(raw[off[k] + s["start"]:off[k] + s["end"]].tobytes().translate(_NORMAL).split())
                     for s in spans[k]) for k in range(batch.num_rows)]
            yield batch.set_column(batch.schema.get_field_index("n_hit"), "n_hit", pa.array(n, pa.int64()))
    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", min_words: int = 1) -> DataFrame:
    """The rows of ``docs`` without any hit, with the columns of ``docs``.
    Items of fewer than ``min_words`` words prove nothing and drop no row."""
    if min_words > 1:
        words = F.array_remove(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+", " "),
                                       " "), "")
        benchmark = benchmark.filter(F.size(words) >= min_words)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{text}`"))
    return find_leaks(packed, benchmark, text).filter("n_hit = 0").select("_row.*")


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    hits = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return hits.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
                       F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
                       (F.col("n_hit") > 0).alias("contaminated"))


def hits_sql(docs: str = "documents") -> str:
    """DuckDB CTEs ending in ``leaks`` (one row per row of ``docs``)."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    return f"""bw AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({low}, {word}) AS w FROM benchmark),
bwin AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM bw WHERE len(w) > 0)),
dw AS (SELECT row_number() OVER () AS did, *, regexp_extract_all({low}, {word}) AS dwords FROM {docs}),
dwin AS (
  SELECT did, n, i, array_to_string(dwords[i:i + n - 1], ' ') AS g
  FROM (SELECT did, dwords, n, unnest(range(1, CAST(len(dwords) - n + 2 AS BIGINT))) AS i
        FROM dw, (SELECT DISTINCT n FROM bwin) WHERE len(dwords) >= n)),
hit AS (SELECT did, i, n, item FROM dwin JOIN bwin USING (n, g)),
hitw AS (SELECT did, count(*) AS n_hit FROM (SELECT DISTINCT did, unnest(range(i, i + n)) AS p FROM hit) GROUP BY did),
hiti AS (SELECT did, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
         FROM (SELECT DISTINCT did, item FROM hit) GROUP BY did),
leaks AS (
  SELECT d.*, CAST(len(dwords) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
         CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
         coalesce(n_hit, 0) > 0 AS contaminated
  FROM dw d LEFT JOIN hitw USING (did) LEFT JOIN hiti USING (did))"""


SQL = f"WITH {hits_sql()} SELECT doc_id, n_words, n_hit, n_items, items_sha256, contaminated FROM leaks"
