"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set is its distinct word shingles (64-bit hashes).  All tokens
are put in one global order, rare ones first.  If two sets of n and m tokens
have a Jaccard similarity of at least t, they share at least ceil(t*n) tokens,
so the first n - ceil(t*n) + L tokens of both (their prefixes of level L)
share at least L tokens, for every L up to ceil(t*n).  Level 1 is the usual
prefix filter.  Each document picks the level whose estimated cost is least:
its prefix grows by one token per level, which adds index postings, but a
candidate must then share that many prefix tokens before it is verified.  A
pair uses the smaller of its two levels, so both have the needed tokens.

Steps, each a Spark job over narrow rows
 1. a count sketch of fixed size orders the tokens (an estimate: any order
    is correct, a good one keeps frequent tokens out of the prefixes);
 2. documents with equal sets become one node; prefixes of the nodes are
    exploded, tokens of one node only dropped, and levels chosen;
 3. every node is verified against one leader, the most central node of the
    prefix token buckets they share most often; verified links are merged
    into components;
 4. nodes of different components that share a token of at most ``HOT_DF``
    nodes are joined, their shared tokens counted and pairs with enough of
    them verified exactly;
 5. nodes of different components that share a more frequent token are
    compared in blocks: a task verifies all pairs of two blocks on whole sets
    and returns only links that join components.  A group of near copies is
    mostly one component by then, and blocks of one component are skipped, so
    a large group is neither listed as pairs nor gathered in one task;
 6. components of all verified links.

No link between different components is lost on the way, so the result is
the components of all links; links inside a component are not listed.

Defined results: a text without words (null, empty, blank) has an empty set,
is linked with nothing and its own component; repeated rows have equal sets
and so one component; a null ``doc_id`` takes part by its text, and a
component's id is its smallest non-null doc_id; extra columns are ignored; an
empty table gives an empty result.  Nodes are identified by a 64-bit hash of
their set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._bytes import blocks, list_array, mix, trimmed, word_hashes, words
from ._graph import components
from ..operators.prefix import positions
from ._store import drop, release, saved

_U = np.uint64
WIDTH, PERCENT, MAX_LEVEL, VERIFY_COST = 5, 80, 6, 20.0
HOT_DF, BLOCK_NODES = 64, 256
SKETCH_BITS, SKETCH_CHUNK = 20, 1 << 14
_MULT = mix(np.arange(11, 11 + 64, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)


def shingle_sets(raw: np.ndarray, off: np.ndarray, width: int):
    """Sorted distinct shingle hashes of each text of a block."""
    starts, ends, first = words(raw, off)
    h = word_hashes(raw, starts, ends)
    if len(h) >= width:
        n = len(h) - width + 1
        acc = np.zeros(n, _U)
        for j in range(width):
            acc += h[j:j + n] * _MULT[j]
        grams = mix(acc)
    for d in range(len(off) - 1):
        a, b = first[d], first[d + 1]
        m = b - a
        if m >= width:
            yield np.unique(grams[a:b - width + 1])
        elif m:
            yield mix((h[a:b] * _MULT[:m]).sum(keepdims=True) + _MULT[m + 8:m + 9])
        else:
            yield np.zeros(0, _U)


def sketch_counts(text: str, width: int, bits: int):
    """Partial token counts of one task, in chunks of a fixed-size sketch."""
    def run(batches):
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for _, _, raw, off in blocks(batch.column(text)):
                sets = list(shingle_sets(raw, off, width))
                total += np.bincount((np.concatenate(sets) >> _U(64 - bits)).astype(np.int64), minlength=1 << bits)
        parts = total.reshape(-1, min(SKETCH_CHUNK, 1 << bits))
        for k, part in enumerate(parts):
            if part.any():
                yield pa.RecordBatch.from_pydict({"chunk": [k], "counts": [part.tobytes()]},
                                                 schema=pa.schema([("chunk", pa.int32()), ("counts", pa.binary())]))
    return run


def add_chunks(batches):
    """Sum of the partial counts, chunk by chunk."""
    total: dict = {}
    for batch in batches:
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1)):
            part = np.frombuffer(c.as_buffer(), np.int64)
            total[k] = total[k] + part if k in total else part.copy()
    for k, part in total.items():
        yield pa.RecordBatch.from_pydict({"chunk": [k], "counts": [part.tobytes()]},
                                         schema=pa.schema([("chunk", pa.int32()), ("counts", pa.binary())]))


def token_sketch(docs: DataFrame, text: str, width: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """Token counts by hash prefix, saturated to 16 bits: 2**bits counters
    however large the corpus is."""
    spark = docs.sparkSession
    parts = docs.select(text).mapInArrow(trimmed(sketch_counts(text, width, bits)), "chunk int, counts binary")
    n = max(1, (1 << bits) // SKETCH_CHUNK)
    out = np.zeros(1 << bits, np.int64)
    for r in parts.repartition(n, "chunk").mapInArrow(add_chunks, "chunk int, counts binary").collect():
        part = np.frombuffer(r["counts"], np.int64)
        out[r["chunk"] * len(part):(r["chunk"] + 1) * len(part)] = part
    return np.minimum(out, 65535).astype(np.uint16)


def set_rows(text: str, width: int, percent: int, sketch, bits: int, max_level: int):
    """Per document: set size, node (hash of the set) and the prefix of the
    highest level."""
    def run(batches):
        counts = sketch.value
        for batch in batches:
            ns, nodes, prefixes = [], [], []
            for _, _, raw, off in blocks(batch.column(text)):
                for u in shingle_sets(raw, off, width):
                    n = len(u)
                    need = -(-percent * n // 100)
                    ns.append(n)
                    nodes.append(int(mix(mix(u).sum(keepdims=True) + _U(n))[0]) if n else 0)
                    rare = np.argsort(counts[(u >> _U(64 - bits)).astype(np.int64)], kind="stable")
                    prefixes.append(u[rare[:n - need + min(max_level, need)]])
            offsets = np.concatenate(([0], np.cumsum([len(p) for p in prefixes])))
            flat = np.concatenate(prefixes).view(np.int64) if prefixes else np.zeros(0, np.int64)
            keep = [c for c in batch.schema.names if c != text]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep]
                + [pa.array(ns, pa.int64()), pa.array(np.array(nodes, _U).view(np.int64)),
                   list_array(flat, offsets, pa.int64())], names=keep + ["n", "node", "prefix"])
    return run


FILTER_BITS = 25


def filter_bits(bits: int):
    """One task's part of a fixed-size bitmap of 64-bit keys, in chunks."""
    def run(batches):
        total = np.zeros(1 << (bits - 3), np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy().view(_U) >> _U(64 - bits)
            np.bitwise_or.at(total, (at >> _U(3)).astype(np.int64), np.uint8(1) << (at & _U(7)).astype(np.uint8))
        for k, part in enumerate(total.reshape(-1, min(1 << 16, len(total)))):
            if part.any():
                yield pa.RecordBatch.from_pydict({"chunk": [k], "bits": [part.tobytes()]},
                                                 schema=pa.schema([("chunk", pa.int32()), ("bits", pa.binary())]))
    return run


def or_chunks(batches):
    total: dict = {}
    for batch in batches:
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1)):
            part = np.frombuffer(c.as_buffer(), np.uint8)
            total[k] = total[k] | part if k in total else part.copy()
    for k, part in total.items():
        yield pa.RecordBatch.from_pydict({"chunk": [k], "bits": [part.tobytes()]},
                                         schema=pa.schema([("chunk", pa.int32()), ("bits", pa.binary())]))


def key_filter(keys: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """Bitmap of hashed keys: 2**bits bits whatever their number.  It may let
    a key pass that is not there, never the other way round."""
    schema, size = "chunk int, bits binary", 1 << (bits - 3)
    chunks = keys.mapInArrow(filter_bits(bits), schema).repartition(max(1, size >> 16), "chunk").mapInArrow(or_chunks, schema)
    out = np.zeros(size, np.uint8)
    for r in chunks.collect():
        part = np.frombuffer(r["bits"], np.uint8)
        out[r["chunk"] * len(part):(r["chunk"] + 1) * len(part)] = part
    return out


def full_sets(text: str, key: str, width: int, passing, bits: int):
    """(node, tokens) of the texts whose key passes the filter."""
    def run(batches):
        have = passing.value
        for batch in batches:
            at = batch.column(key).to_numpy().view(_U) >> _U(64 - bits)
            hit = (have[(at >> _U(3)).astype(np.int64)] >> (at & _U(7)).astype(np.uint8)) & 1
            texts = batch.column(text).filter(pa.array(hit.astype(bool)))
            for _, _, raw, off in blocks(texts):
                sets = list(shingle_sets(raw, off, width))
                nodes = [int(mix(mix(u).sum(keepdims=True) + _U(len(u)))[0]) if len(u) else 0 for u in sets]
                offsets = np.concatenate(([0], np.cumsum([len(u) for u in sets])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(nodes, _U).view(np.int64)),
                     list_array(np.concatenate(sets).view(np.int64), offsets, pa.int64())], names=["node", "tokens"])
    return run


def choose_levels(postings: DataFrame, max_level: int, verify_cost: float, percent: int, hot_df: int) -> DataFrame:
    """Rows (token, node, n, level, df) within the level ``ell`` each node
    picks: the one with the least estimated cost.  With P postings met by
    the prefix of level L, at most P / L other nodes share L of its tokens,
    so the estimate is P + verify_cost * P / L.  ``mass`` is the sum of the
    node's df, ``hot`` the number of its tokens above ``hot_df``."""
    w = Window.partitionBy("node")
    cost = [F.sum(F.when(F.col("level") <= k, F.col("df") - 1).otherwise(0)).over(w) * (1 + verify_cost / k)
            for k in range(1, max_level + 1)]
    need = F.ceil(F.col("n") * percent / 100)
    costs = F.array(*[F.when(F.lit(k) <= need, c).otherwise(F.lit(float("inf"))) for k, c in enumerate(cost, 1)])
    best = F.expr("array_position(costs, array_min(costs))").cast("int")
    return (postings.withColumns({"costs": costs, "mass": F.sum("df").over(w),
                                  "hot": F.count(F.when(F.col("df") > hot_df, 1)).over(w).cast("int")})
            .withColumn("ell", best).filter("level <= ell").drop("costs"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar enough, exactly."""
    a = sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta"))
    b = sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    return (pairs.join(a, "a").join(b, "b")
            .filter(100 * both >= percent * (F.size("ta") + F.size("tb") - both)).select("a", "b"))


def leader_pairs(index: DataFrame, percent: int) -> DataFrame:
    """Each node with the leader it shares most prefix tokens with.  A
    bucket's leader is its node of the greatest mass: one with few tokens of
    its own, so the most central of a group of near copies.  These pairs only
    contract large groups early; unlikely ones are left to the later joins."""
    lead = index.groupBy("token").agg(F.max_by(F.struct("node", "n", "ell"), F.struct("mass", "node")).alias("b"))
    hits = (index.join(lead, "token").filter("node <> b.node")
            .filter(100 * F.least("n", "b.n") >= percent * F.greatest("n", "b.n"))
            .groupBy(F.col("node").alias("a"), F.col("b.node").alias("b"))
            .agg(F.count(F.lit(1)).alias("k"), F.max(F.least("ell", "b.ell")).alias("need")).filter("k >= need"))
    return hits.groupBy("a").agg(F.max_by("b", F.struct("k", "b")).alias("b"))


def with_labels(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    return nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def cold_pairs(index: DataFrame, labels: DataFrame, percent: int, hot_df: int) -> DataFrame:
    """Candidate pairs (a, b) of nodes in different components that share a
    token of at most ``hot_df`` nodes, so at most hot_df / 2 pairs a posting.
    Frequent tokens are not joined: each node counts all of its own instead."""
    x = with_labels(index.filter(F.col("df") <= hot_df), labels).drop("df", "mass")
    y = x.select("token", *[F.col(c).alias(f"{c}2") for c in ("node", "n", "level", "ell", "hot", "label")])
    met = (x.join(y, "token").filter("node < node2 AND label <> label2")
           .filter(100 * F.least("n", "n2") >= percent * F.greatest("n", "n2"))
           .withColumn("need", F.least("ell", "ell2")).filter("greatest(level, level2) <= need"))
    return (met.groupBy(F.col("node").alias("a"), F.col("node2").alias("b"))
            .agg(F.count(F.lit(1)).alias("k"), F.max(F.col("need") - F.least("hot", "hot2")).alias("need"))
            .filter("k >= need").select("a", "b"))


def hot_blocks(index: DataFrame, labels: DataFrame, percent: int, hot_df: int, block_nodes: int):
    """The nodes with frequent tokens in blocks, and the pairs of blocks that
    may hold similar nodes of different components.

    A node's cluster is its most frequent token; nodes of the cluster's main
    component and others are in blocks of their own.  Two clusters meet if a
    frequent token has nodes of both.  Blocks of one and the same component,
    or of sets of too different sizes, are not compared."""
    hot = index.filter(F.col("df") > hot_df)
    nodes = hot.groupBy("node").agg(F.first("n").alias("n"), F.max_by("token", F.struct("df", "token")).alias("cluster"))
    nodes = saved(with_labels(nodes, labels), "hot-nodes")
    main = nodes.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("cluster").agg(
        F.max_by("label", F.struct("k", "label")).alias("main"))
    placed = positions(nodes.join(main, "cluster").withColumn("main", F.col("label") == F.col("main")),
                       ["cluster", "main"], ["node"], "pos")
    placed = saved(placed.withColumn("block", F.xxhash64("cluster", "main", F.floor(F.col("pos") / block_nodes))).drop("pos"),
                   "hot-placed")
    drop(nodes)
    blocks_ = placed.groupBy("block", "cluster", "main").agg(
        F.first("label").alias("label"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    of_token = hot.select("token", "node").join(placed.select("node", "cluster"), "node").select("token", "cluster").distinct()
    meet = (of_token.join(of_token.withColumnRenamed("cluster", "cluster2"), "token").filter("cluster <= cluster2")
            .select("cluster", "cluster2").distinct())
    other = blocks_.select(*[F.col(c).alias(f"{c}2") for c in blocks_.columns])
    pairs = (meet.join(blocks_, "cluster").join(other, "cluster2")
             .filter("cluster <> cluster2 OR block <= block2")
             .filter("NOT (main AND main2 AND label = label2)")
             .filter((100 * F.col("hi") >= percent * F.col("lo2")) & (100 * F.col("hi2") >= percent * F.col("lo")))
             .select(F.xxhash64("block", "block2").alias("pair"), "block", "block2"))
    return placed, saved(pairs, "block-pairs")


def block_links(percent: int):
    """Links between the two sides of each pair of blocks (rows in the order
    of the pair), reduced to a spanning set over the components they join."""
    def sparse(sets, columns, at, width):
        out = np.zeros((len(sets), width), np.float32)
        for k, x in enumerate(sets):
            x = x[(x >= at) & (x < at + width)]
            out[k, x - at] = 1
        return out

    def links(rows):
        sides = [[r for r in rows if r[0] & bit] for bit in (1, 2)]
        a, b = sides
        flat = np.concatenate([r[4] for r in rows])
        _, col, count = np.unique(flat, return_inverse=True, return_counts=True)
        number = np.cumsum(count > 1) - 1                       # tokens of one node only cannot be shared
        cut = np.cumsum([0] + [len(r[4]) for r in rows])
        local = {r[1]: number[c[count[c] > 1]] for r, c in ((r, col[cut[k]:cut[k + 1]]) for k, r in enumerate(rows))}
        sa, sb = [local[r[1]] for r in a], [local[r[1]] for r in b]
        width = int(number[-1]) + 1 if len(number) else 0
        both = np.zeros((len(a), len(b)), np.float32)
        for at in range(0, width, 4096):
            w = min(4096, width - at)
            both += sparse(sa, width, at, w) @ sparse(sb, width, at, w).T
        both = np.rint(both).astype(np.int64)
        na, nb = np.array([r[2] for r in a]), np.array([r[2] for r in b])
        hit = 100 * both >= percent * (na[:, None] + nb - both)
        la, lb = np.array([r[3] for r in a]), np.array([r[3] for r in b])
        hit &= (la[:, None] != lb) & (both > 0)
        parent: dict = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for i, j in zip(*np.nonzero(hit)):
            x, y = find(la[i]), find(lb[j])
            if x != y:
                parent[max(x, y)] = min(x, y)
                yield int(a[i][1]), int(b[j][1])

    def run(batches):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        pair, rows = None, []

        def done():
            found = list(links(rows)) if rows else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], schema=schema)

        for batch in batches:
            cols = [batch.column(c) for c in ("pair", "side", "node", "n", "label")]
            tokens = batch.column("tokens")
            for k, (p, side, node, n, label) in enumerate(zip(*[c.to_pylist() for c in cols])):
                if p != pair:
                    if rows:
                        yield done()
                    pair, rows = p, []
                rows.append((side, node, n, label, tokens[k].values.to_numpy()))
        if rows:
            yield done()
    return run


def hot_links(docs, rows, index, labels, width: int, percent: int, hot_df: int, block_nodes: int) -> DataFrame:
    """Saved links, between different components, of nodes that share a
    frequent prefix token: all pairs of two blocks are verified on whole sets
    within a task, and only the links that join components leave it."""
    spark = docs.sparkSession
    placed, pairs = hot_blocks(index, labels, percent, hot_df, block_nodes)
    release(spark)
    member = pairs.select("pair", F.explode(F.array(
        F.struct(F.col("block").alias("block"), F.when(F.col("block") == F.col("block2"), 3).otherwise(1).alias("side")),
        F.struct(F.col("block2").alias("block"), F.when(F.col("block") == F.col("block2"), 0).otherwise(2).alias("side")))).alias("x"))
    member = member.select("pair", "x.*").filter("side > 0")
    used = placed.join(member.select("block").distinct(), "block", "left_semi")
    sets = node_sets(docs, rows, used.select("node"), width)
    release(spark)
    full = placed.select("block", "node", "n", "label").join(sets, "node")
    out = saved(member.join(full, "block").select("pair", "side", "node", "n", "label", "tokens")
                .repartition("pair").sortWithinPartitions("pair", "node")
                .mapInArrow(trimmed(block_links(percent)), "a long, b long"), "hot-links")
    for x in (sets, placed, pairs):
        drop(x)
    release(spark)
    return out


def prefix_index(rows: DataFrame, percent: int, max_level: int, verify_cost: float, hot_df: int) -> DataFrame:
    """Saved postings (token, node, n, level, ell) of the tokens that two
    nodes or more have in their prefixes."""
    nodes = rows.filter("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    flat = nodes.select("node", "n", F.posexplode("prefix").alias("pos", "token"))
    base = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    flat = flat.select("token", "node", F.col("n").cast("int"),
                       F.greatest(F.lit(1), F.col("pos") - base + 2).cast("int").alias("level"))
    shared = flat.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    return saved(choose_levels(flat.join(shared, "token"), max_level, verify_cost, percent, hot_df), "index")


def node_sets(docs: DataFrame, rows: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """Saved full sets (node, tokens) of ``nodes``, each made from one of the
    node's documents.  The texts are scanned behind a filter of fixed size
    and never shuffled; a few other sets may slip in, which no join finds."""
    spark = docs.sparkSession
    row = F.struct("text_hash", F.col("doc_id").isNull().alias("x"), "doc_id")
    one = (rows.join(nodes.distinct(), "node", "left_semi").groupBy("node").agg(F.min(row).alias("r"))
           .select(F.xxhash64("r.text_hash", "r.doc_id").alias("key")))
    passing = spark.sparkContext.broadcast(key_filter(one))
    texts = docs.select("text", F.xxhash64("text_hash", "doc_id").alias("key"))
    out = saved(texts.mapInArrow(trimmed(full_sets("text", "key", width, passing, FILTER_BITS)), "node long, tokens array<long>"),
                "tokens")
    passing.destroy()
    return out


def similar(docs: DataFrame, rows: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Saved: the saved ``pairs`` that hold, verified on whole sets."""
    sets = node_sets(docs, rows, pairs.select(F.explode(F.array("a", "b")).alias("node")), width)
    release(docs.sparkSession)
    out = saved(verified(pairs, sets, percent), "links")
    drop(sets)
    release(docs.sparkSession)
    return out


def similar_links(docs: DataFrame, rows: DataFrame, index: DataFrame, width: int, percent: int, hot_df: int,
                  block_nodes: int) -> DataFrame:
    """Saved verified links whose components are those of all links."""
    near = similar(docs, rows, saved(leader_pairs(index, percent), "pairs"), width, percent)
    labels = components(near)
    pairs = saved(cold_pairs(index, labels, percent, hot_df), "pairs")
    release(docs.sparkSession)
    near = near.unionByName(similar(docs, rows, pairs, width, percent))
    labels = components(near)
    return near.unionByName(hot_links(docs, rows, index, labels, width, percent, hot_df, block_nodes))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH,
                    percent: int = PERCENT, max_level: int = MAX_LEVEL, verify_cost: float = VERIFY_COST,
                    sketch_bits: int = SKETCH_BITS, hot_df: int = HOT_DF, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """(doc_id, text_hash, n_shingles, node, component, component_id) per row
    of ``docs``: component is null for an empty set, component_id the
    smallest doc_id reachable by links."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"),
                       F.xxhash64(F.col(text)).alias("text_hash"))
    sketch = spark.sparkContext.broadcast(token_sketch(docs, "text", width, sketch_bits))
    wide = saved(docs.mapInArrow(trimmed(set_rows("text", width, percent, sketch, sketch_bits, max_level)),
                                 "doc_id long, text_hash long, n long, node long, prefix array<long>"), "sets")
    sketch.destroy()
    release(spark)
    index = prefix_index(wide, percent, max_level, verify_cost, hot_df)
    rows = saved(wide.drop("prefix"), "nodes")
    drop(wide)
    release(spark)
    links = similar_links(docs, rows, index, width, percent, hot_df, block_nodes)
    drop(index)
    release(spark)
    labels = components(links)
    out = (rows.join(labels, "node", "left")
           .withColumn("component", F.when(F.col("n") > 0, F.coalesce("label", "node"))).drop("label"))
    ids = out.filter("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("id"))
    return (out.join(ids, "component", "left")
            .select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "node", "component",
                    F.when(F.col("n") > 0, F.col("id")).otherwise(F.col("doc_id")).alias("component_id")))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row of each component stays (its smallest doc_id; rows without
    words all stay), with the columns of ``docs``."""
    found = near_duplicates(docs, doc_id, text, **how)
    first = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "text_hash")
    keep = (found.filter("component IS NOT NULL").groupBy("component").agg(F.min(first).alias("k"))
            .select(F.col("k.doc_id").alias("_id"), F.col("k.text_hash").alias("_th")))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(row, F.col(f"`{doc_id}`").cast("long").alias("_i"), F.xxhash64(F.col(f"`{text}`")).alias("_t"),
                       (~F.coalesce(F.col(f"`{text}`"), F.lit("")).rlike("[^ \\t\\n\\x0B\\f\\r]")).alias("_blank"))
    blank = rows.filter("_blank").select("_row.*")
    pick = rows.filter("NOT _blank").join(keep, (F.col("_t") == F.col("_th")) & F.col("_i").eqNullSafe(F.col("_id")))
    once = Window.partitionBy("_th", "_id").orderBy("_t")
    return (pick.withColumn("_k", F.row_number().over(once)).filter("_k = 1").select("_row.*").unionByName(blank))


def op8_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id")


def links_sql(docs: str = "documents") -> str:
    """DuckDB CTEs (recursive) ending in ``grouped`` (d: row number of
    ``docs``, n_shingles, component_id)."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""jw AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all({low}, '[^\x20\x09-\x0D]+') AS w FROM {docs}),
js AS (
  SELECT DISTINCT d, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT d, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM jw WHERE len(w) > 0)),
jn AS (SELECT d, count(*) AS n FROM js GROUP BY d),
jp AS (
  SELECT x.d AS a, y.d AS b, count(*) AS k FROM js x JOIN js y ON x.g = y.g AND x.d < y.d GROUP BY 1, 2),
jl AS (
  SELECT a, b FROM jp JOIN jn p ON p.d = a JOIN jn q ON q.d = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
je AS (SELECT a, b FROM jl UNION ALL SELECT b, a FROM jl),
reach(d, r) AS (SELECT d, d FROM jw UNION SELECT reach.d, je.b FROM reach JOIN je ON je.a = reach.r),
grouped AS (
  SELECT j.d, j.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, m.component_id
  FROM jw j LEFT JOIN jn USING (d)
  JOIN (SELECT reach.d, min(t.doc_id) AS component_id FROM reach JOIN jw t ON t.d = reach.r GROUP BY 1) m USING (d))"""


SQL = f"WITH RECURSIVE {links_sql()} SELECT doc_id, n_shingles, component_id FROM grouped"
