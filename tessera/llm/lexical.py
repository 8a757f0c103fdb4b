"""Ranked lexical search by dense blocked matrix products.

Terms are runs ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z
lower-cased.  A document's score for an item is the sum, over the item's
terms, of a weight (from the number of documents with the term) times an
impact (from the term's count and the document's length), all in whole numbers.

 1. every text is read once: the counts of terms that some item has, and the
    number of all terms, become a narrow saved table (the postings);
 2. sums over it give the number of documents, of terms, and of documents
    with each term;
 3. a task takes the postings in tiles of ``TILE_DOCS`` documents.  For a tile
    of ``TILE_ITEMS`` items, whose own vocabulary is numbered compactly and cut
    into tiles of ``TILE_TERMS``, the score is a product of a dense matrix of
    weights (items x terms) and one of impacts (terms x documents) in float64.
    Impacts are below 10**6; a vocabulary tile is never wider than 2**53 over
    10**6 times the largest weight, so every partial sum is a whole number
    below 2**53 and exact in any order of addition.  Tiles are added up as
    64-bit integers;
 4. a task keeps the ``k`` best documents of each item, ties by document id,
    and the answers of the tasks are ranked in two rounds.

What is broadcast is bounded: items are cut into groups of at most
``GROUP_TERMS`` terms in all (an item is never cut), and each group reads the
texts once.  Terms are told apart by 64-bit hashes.

Defined results: a null or empty text has no terms and is never found; an item
without terms, or without a document that has one of them, has no rows; every
row of the items is an item and every row of the documents a document, also if
repeated; a null doc_id comes last at ties; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.prefix import positions, prefix_sums
from ._bytes import _BASE, _INV, _TABLE, LOWER, blocks, list_array, mix, powers, trimmed
from ._store import saved

TOP_K = 10
GROUP_TERMS = 1 << 17
TILES = TILE_ITEMS, TILE_TERMS, TILE_DOCS = 256, 1024, 1024
IMPACT_BOUND = 10 ** 6
MERGE_PARTS = 64
_U = np.uint64

_TERM = np.zeros(256, bool)
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = _TERM[128:] = True


def terms(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the terms of a block, first term of each text)."""
    n = len(raw)
    solid = _TERM[raw]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:n]
    last[:-1] &= ~solid[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(starts):
        return np.zeros(0, _U), np.zeros(len(off), np.int64)
    h = np.add.reduceat(np.where(solid, _TABLE[LOWER[raw]], _U(0)) * powers(_BASE, n), starts)
    return mix(h * powers(_INV, n)[starts] + (ends - starts).astype(_U)), np.searchsorted(starts, off)


# ---- items ---------------------------------------------------------------------

def distinct_terms(batches):
    for batch in batches:
        for i, j, raw, off in blocks(batch.column("text")):
            h, first = terms(raw, off)
            each = [np.unique(h[a:b]) for a, b in zip(first[:-1], first[1:])]
            size = np.concatenate(([0], np.cumsum([len(x) for x in each])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("item").slice(i, j - i), list_array(np.concatenate(each).view(np.int64), size, pa.int64())],
                names=["item", "terms"])


def item_terms(items: DataFrame, group_terms: int) -> tuple[DataFrame, DataFrame]:
    """Saved (item, item_id) and (item, terms, group): items numbered from 0,
    their distinct terms, and the group of at most ``group_terms`` terms."""
    rows = positions(items.select("item_id", "text"), [], ["item_id", "text"], "item")
    rows = saved(rows, "items")
    found = rows.select("item", "text").mapInArrow(distinct_terms, "item long, terms array<long>")
    found = prefix_sums(found, [], "item", [], {"_before": F.size("terms").cast("long")})
    return rows.select("item", "item_id"), saved(
        found.select("item", "terms", F.floor(F.col("_before") / group_terms).alias("group")), "item-terms")


# ---- postings ------------------------------------------------------------------

def count_terms(vocabulary):
    """(doc_id, n, terms, tf): number of terms of each text, and which terms
    of the vocabulary it has how often."""
    def run(batches):
        known = vocabulary.value
        for batch in batches:
            for i, j, raw, off in blocks(batch.column("text")):
                h, first = terms(raw, off)
                doc = np.repeat(np.arange(j - i), np.diff(first))
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                ok = known[at] == h
                pair, tf = np.unique(doc[ok] * len(known) + at[ok], return_counts=True)
                doc, term = np.divmod(pair, len(known))
                edge = np.searchsorted(doc, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(np.diff(first), pa.int64()),
                     list_array(term, edge, pa.int32()), list_array(tf, edge, pa.int64())], names=["doc_id", "n", "terms", "tf"])
    return run


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Impact of a term with count ``tf`` in a document of ``n`` terms."""
    if len(n) and 90 * int(n.max()) * n_docs >= 1 << 63:
        n = n.astype(object)                             # beyond 64 bits only in the product
    m = (100 - 90 + (90 * n * n_docs) // n_terms).astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


# ---- products ------------------------------------------------------------------

def item_tiles(members: list, weight: np.ndarray, n_items: int, n_terms: int):
    """Tiles of items: (first item, number of items, vocabulary tiles), each of
    the latter with its terms and the places (item, term) of its weights."""
    width = min(n_terms, (1 << 53) // max(1, IMPACT_BOUND * int(weight.max(initial=1))))
    for a in range(0, len(members), n_items):
        part = members[a:a + n_items]
        item = np.repeat(np.arange(len(part)), [len(x) for x in part])
        own, place = np.unique(np.concatenate(part), return_inverse=True)
        tiles = []
        for lo in range(0, len(own), width):
            pick = (place >= lo) & (place < lo + width)
            tiles.append((own[lo:lo + width], item[pick], place[pick] - lo))
        yield a, len(part), tiles


class Best:
    """The ``k`` best documents of each item so far, ties by document id."""

    def __init__(self, items: int, k: int):
        self.items, self.k = items, k
        self.item = self.score = self.doc = np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)
        self.least = np.zeros(items, np.int64)           # score that a full list ends with

    def add(self, first: int, scores: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        least = self.least[first:first + len(scores), None]
        item, at = np.nonzero((scores > 0) & (scores >= least))
        if not len(item):
            return
        item, score, doc, null = (np.concatenate(x) for x in (
            (self.item, item + first), (self.score, scores[item, at]), (self.doc, doc[at]), (self.null, null[at])))
        order = np.lexsort((doc, null, -score, item))
        item, score, doc, null = item[order], score[order], doc[order], null[order]
        head = np.searchsorted(item, np.arange(self.items))
        rank = np.arange(len(item)) - head[item]
        keep = rank < self.k
        self.item, self.score, self.doc, self.null = item[keep], score[keep], doc[keep], null[keep]
        full = rank == self.k - 1
        self.least[item[full]] = score[full]


def best_documents(shared, k: int, sizes: tuple):
    """(item, doc_id, score) of the ``k`` best documents of the task for each item."""
    def run(batches):
        numbers, members, weight, n_docs, n_terms = shared.value
        tiles = list(item_tiles(members, weight, *sizes[:2]))
        best = Best(len(members), k)
        for batch in batches:
            doc_id = batch.column("doc_id")
            null = doc_id.is_null().to_numpy(zero_copy_only=False)
            doc = doc_id.fill_null(0).to_numpy()
            n, lists, tf = batch.column("n").to_numpy(), batch.column("terms"), batch.column("tf")
            edge = lists.offsets.to_numpy()
            term, tf = lists.values.to_numpy(), tf.values.to_numpy()
            for a in range(0, batch.num_rows, sizes[2]):
                b = min(a + sizes[2], batch.num_rows)
                lo, hi = edge[a], edge[b]
                column = np.repeat(np.arange(b - a), np.diff(edge[a:b + 1]))
                impact = impacts(tf[lo:hi], n[a:b][column], n_docs, n_terms).astype(np.float64)
                for first, items, parts in tiles:
                    scores = np.zeros((items, b - a), np.int64)
                    for own, item, place in parts:
                        at = np.minimum(np.searchsorted(own, term[lo:hi]), len(own) - 1)
                        ok = own[at] == term[lo:hi]
                        if not ok.any():
                            continue
                        x = np.zeros((len(own), b - a))
                        x[at[ok], column[ok]] = impact[ok]
                        w = np.zeros((items, len(own)))
                        w[item, place] = weight[own[place]]
                        scores += (w @ x).astype(np.int64)
                    best.add(first, scores, doc[a:b], null[a:b])
        yield pa.RecordBatch.from_arrays(
            [pa.array(numbers[best.item], pa.int64()), pa.array(best.doc, pa.int64(), mask=best.null), pa.array(best.score)],
            names=["item", "doc_id", "score"])
    return run


def search_group(docs: DataFrame, rows: list, k: int, sizes: tuple) -> DataFrame:
    """(item, doc_id, score): the best documents of each task for one group of items."""
    sc = docs.sparkSession.sparkContext
    rows = [r for r in rows if r["terms"]]
    numbers = np.array([r["item"] for r in rows], np.int64)
    hashes = [np.array(r["terms"], np.int64).view(_U) for r in rows]
    vocabulary = np.unique(np.concatenate(hashes)) if rows else np.zeros(1, _U)
    postings = saved(docs.mapInArrow(trimmed(count_terms(sc.broadcast(vocabulary))),
                                     "doc_id long, n long, terms array<int>, tf array<long>"), "postings")
    n_docs, n_terms = postings.filter("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in postings.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect():
        df[r["t"]] = r["n"]                              # one row for each term of the group
    members = [np.searchsorted(vocabulary, h) for h in hashes]
    shared = sc.broadcast((numbers, members, weights(n_docs, df), n_docs, n_terms))
    return postings.filter("size(terms) > 0").mapInArrow(
        trimmed(best_documents(shared, k, sizes)), "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = TOP_K, text: str = "text", doc_id: str = "doc_id",
           group_terms: int = GROUP_TERMS, sizes: tuple = TILES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents with a score
    above 0 for each row of ``items`` (item_id, text)."""
    names, found = item_terms(items, group_terms)
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    groups = [r["group"] for r in found.select("group").distinct().orderBy("group").collect()]   # terms / GROUP_TERMS
    parts = [search_group(texts, found.filter(F.col("group") == g).orderBy("item").collect(), k, sizes)
             for g in groups or [0]]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    first = Window.partitionBy("item", "_part").orderBy(*order)
    out = (out.withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(MERGE_PARTS)))
           .withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
    return out.join(names, "item").select("item_id", "rank", "doc_id", "score")


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FOUND = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""
WITH b AS (
  SELECT iid, item_id, unnest(list_distinct(w)) AS term
  FROM (SELECT row_number() OVER () AS iid, item_id, {_FOUND} AS w FROM benchmark)),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_FOUND} AS w FROM documents),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
t AS (
  SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d)
  WHERE term IN (SELECT term FROM b) GROUP BY rid, term),
v AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS weight
  FROM (SELECT term, count(*) AS df FROM t GROUP BY term), s),
p AS (
  SELECT iid, item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * len(w) * n_docs) // n_terms))))
         AS BIGINT) AS score
  FROM b JOIN v USING (term) JOIN t USING (term) JOIN d USING (rid), s GROUP BY iid, item_id, rid, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM p WHERE score > 0 QUALIFY rank <= {TOP_K}"""


def op11_lexical_search(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
