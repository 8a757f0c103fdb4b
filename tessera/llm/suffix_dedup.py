"""Removal of repeated passages by two-stage suffix sorting.

A byte goes when a ``WINDOW``-byte string that covers it also starts earlier
(in a document of smaller id, or earlier in the same one).  Equal strings are
brought together in four steps:

 1. anchors: of the ``GRAM``-byte hashes inside a window the least one is the
    window's anchor.  Equal windows have equal anchors, wherever they are.  A
    run of windows with one anchor is a stretch of text, about 1 in 40
    positions begins one;
 2. a join keeps the anchors that occur in two different texts or twice in one
    (copies of a whole text count as one text and are settled by their hash);
 3. only the stretches of such anchors are shuffled, by anchor, so all equal
    windows meet in one task.  Equal stretches are settled as they stream in -
    all but the first go - so a passage that a third of all documents share
    costs one suffix sort, and its copies within a task's batch are dropped
    before the shuffle;
 4. of the distinct stretches, in chunks of whole anchors, the suffixes are
    sorted in two stages: those smaller than their successor (type S) directly,
    the others induced by scanning the buckets of first bytes upwards, each
    ordered by the rank of its successor.  Adjacent common prefixes of at least
    ``WINDOW`` bytes join equal windows; all but the first are removed.

Then the removed ranges of a text are united.  A hash of 64 bits stands for a
whole text and for a stretch; anchors only decide what is compared.

Defined results: a null text has no bytes; texts shorter than the window keep
all bytes; repeated rows (same doc_id and text) are one document and get the
same result; rows of one doc_id with different texts come in the order of
their text hash; a null doc_id comes after all others; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import _BASE, _INV, _TABLE, blocks, mix, powers, trimmed
from ._store import drop, release, saved

WINDOW, GRAM, MAX_RUN = 100, 20, 256
CHUNK_BYTES = 1 << 20       # bytes of stretches sorted at once (whole anchors)
_U = np.uint64
_POS = 24                   # bits of a position within a piece of text
PIECE = 256 << 10             # texts are hashed in blocks of this size
FLUSH = 20_000              # stretches a task looks through for equal ones at once


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    step = 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return np.minimum(x[:len(x) - rest], x[rest:]) if rest else x


def runs(raw: np.ndarray, off: np.ndarray, window: int, gram: int):
    """Runs of windows with one anchor in the texts of a block: (text, first
    window start within the block, number of windows, anchor, whether the
    anchor's gram occurs twice in the run)."""
    n, width = len(raw), window - gram + 1
    if n < window:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, _U), np.zeros(0, bool)
    table = _TABLE[raw] * powers(_BASE, n)
    total = np.concatenate(([_U(0)], np.cumsum(table, dtype=_U)))
    h = mix((total[gram:] - total[:-gram]) * powers(_INV, n)[:n - gram + 1])
    high = (h >> _U(_POS)) << _U(_POS)
    pos = np.arange(len(h), dtype=_U)
    low_mask = _U((1 << _POS) - 1)
    left = _least(high | pos, width)
    right = low_mask - (_least(high | (low_mask - pos), width) & low_mask)
    left = left & low_mask
    anchor = h[left.astype(np.int64)]
    text_of = np.repeat(np.arange(len(off) - 1), np.diff(off))[:len(left)]
    ok = np.arange(len(left)) + window <= off[1:][text_of]
    new = np.ones(len(left), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text_of[1:] != text_of[:-1])
    at = np.flatnonzero(ok)
    head = np.flatnonzero(new[at] | np.concatenate(([True], at[1:] != at[:-1] + 1)))
    first = at[head]
    count = np.diff(np.append(head, len(at)))
    lo, hi = left[at], right[at]
    twice = (np.minimum.reduceat(lo, head) != np.maximum.reduceat(hi, head)) if len(head) else np.zeros(0, bool)
    return text_of[first], first, count, anchor[first], twice


def pieces(raw: np.ndarray, off: np.ndarray, window: int):
    """The block itself, or a text longer than ``PIECE`` in pieces that
    overlap by one window less a byte: (row, bytes, offsets, shift)."""
    if len(raw) <= 2 * PIECE:
        yield raw, off, 0
        return
    for a in range(0, len(raw) - window + 1, PIECE):
        part = raw[a:a + PIECE + window - 1]
        yield part, np.array([0, len(part)]), a


def anchors(window: int, gram: int):
    """(anchor, text hash, occurs twice in the text) of the texts."""
    def run(batches):
        for batch in batches:
            th = batch.column("th").to_numpy()
            for i, _, raw, off in blocks(batch.column("text"), PIECE):
                found = [runs(part, po, window, gram) for part, po, _ in pieces(raw, off, window)]
                doc, anchor, twice = (np.concatenate([x[k] for x in found]) for k in (0, 3, 4))   # of all pieces of a text
                if not len(doc):
                    continue
                order = np.lexsort((anchor, doc))
                d, a, t = doc[order], anchor[order], twice[order]
                head = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (d[1:] != d[:-1]))))
                size = np.diff(np.append(head, len(a)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a[head].view(np.int64)), pa.array(th[i:][d[head]]),
                     pa.array((size > 1) | np.logical_or.reduceat(t, head))], names=["anchor", "th", "twice"])
    return run


STRETCH = "anchor long, content_hash long, doc_id long, th long, start int, length int, content binary"


def stretches(window: int, gram: int):
    """The stretches of the wanted anchors of each text.  Of equal ones in a
    batch only the first keeps its bytes; the others (content null) are
    known to be repeats."""
    def run(batches):
        for batch in batches:
            th, ids = batch.column("th").to_numpy(), batch.column("doc_id").to_numpy()
            wanted = batch.column("anchors")
            out = []
            for i, _, raw, off in blocks(batch.column("text"), PIECE):
                for part, po, shift in pieces(raw, off, window):
                    doc, first, count, anchor, _ = runs(part, po, window, gram)
                    if not len(doc):
                        continue
                    use = np.zeros(len(doc), bool)
                    edge = np.searchsorted(doc, np.arange(len(po)))
                    for d in range(len(po) - 1):
                        a, b = edge[d], edge[d + 1]
                        if b > a:
                            use[a:b] = np.isin(anchor[a:b], wanted[i + d].values.to_numpy().view(_U))
                    for k in np.flatnonzero(use):
                        d = doc[k]
                        for s in range(0, count[k], MAX_RUN):
                            x = first[k] + s
                            size = min(MAX_RUN, count[k] - s) + window - 1
                            out.append((anchor[k], ids[i + d], th[i + d], x - po[d] + shift, part[x:x + size].tobytes()))
                if len(out) > FLUSH:
                    yield from _batches(out)
                    out = []
            yield from _batches(out)
    return run


def _batches(out):
    seen: dict = {}
    out.sort(key=lambda r: (r[1], r[2], r[3]))
    rows = []
    for a, doc, th, start, content in out:
        known = content in seen
        if seen.setdefault(content, (doc, th, start)) == (doc, th, start) and known:
            continue                                            # the same row again
        rows.append((int(np.int64(_U(a).view(np.int64))), None if known else content, doc, th, start, len(content)))
    for i in range(0, len(rows), 20_000):
        part = rows[i:i + 20_000]
        c = [r[1] for r in part]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in part], pa.int64()),
             pa.array([0 if x is None else int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True)
                       for x in c], pa.int64()),
             pa.array([int(r[2]) for r in part], pa.int64()), pa.array([int(r[3]) for r in part], pa.int64()),
             pa.array([int(r[4]) for r in part], pa.int32()), pa.array([r[5] for r in part], pa.int32()),
             pa.array(c, pa.binary())],
            names=["anchor", "content_hash", "doc_id", "th", "start", "length", "content"])


def load_words(x: np.ndarray) -> np.ndarray:
    """Big-endian 8-byte word at every position of ``x``, zero beyond it."""
    padded = np.concatenate((x, np.zeros(8, np.uint8))).astype(_U)
    w = np.zeros(len(x), _U)
    for j in range(8):
        w = (w << _U(8)) | padded[j:j + len(x)]
    return w


def sort_suffixes(x: np.ndarray, begin: np.ndarray, window: int):
    """Two-stage suffix sort of the strings x[begin[i]:begin[i + 1]].

    Returns the window starts in suffix order and the common prefix (at most
    ``window``) of each with the one before it.  Suffixes end with their
    string; what is compared beyond ``window`` bytes is left open.
    """
    n, m = len(x), len(begin) - 1
    size = np.diff(begin)
    owner = np.repeat(np.arange(m), size)
    end = begin[1:][owner]
    idx = np.arange(n)
    # type: the next different byte of the string decides; its end is the least
    change = np.ones(n, bool)
    change[:-1] = (x[1:] != x[:-1]) | (owner[1:] != owner[:-1])
    stop = np.flatnonzero(change)
    run_end = stop[np.searchsorted(stop, idx)]                 # last position of the run of equal bytes
    nxt = run_end + 1
    inside = nxt < end
    small = np.zeros(n, bool)
    small[inside] = x[nxt[inside]] > x[idx[inside]]            # type S: smaller than its successor
    last = begin[1:] - window                                  # last window of each string
    # suffixes to place: up to the first type S at or after the last window
    s_at = np.flatnonzero(small)
    q = np.searchsorted(s_at, last)
    until = np.where((q < len(s_at)), s_at[np.minimum(q, max(0, len(s_at) - 1))] if len(s_at) else n, n)
    until = np.minimum(until, begin[1:] - 1)
    place = idx <= until[owner]
    w8 = load_words(x)

    def word(p, d):
        """Word ``d`` of the suffixes at ``p``, cut at the string's end."""
        at = p + 8 * d
        left = end[p] - at
        v = w8[np.minimum(at, n - 1)]
        keep = np.clip(left, 0, 8)
        return np.where(keep > 0, v & (_U(0xFFFFFFFFFFFFFFFF) << ((8 - np.maximum(keep, 1)) * 8).astype(_U)), _U(0))

    # stage 1: direct sort of type S, refining only what is still tied
    pos = np.flatnonzero(small & place)
    group = np.zeros(len(pos), np.int64)
    active = np.arange(len(pos))
    for d in range(-(-window // 8)):
        if not len(active):
            break
        p, g = pos[active], group[active]
        key = word(p, d)
        o = np.lexsort((key, g))
        p, g, key = p[o], g[o], key[o]
        pos[active] = p
        new = np.concatenate(([True], (g[1:] != g[:-1]) | (key[1:] != key[:-1])))
        head = np.flatnonzero(new)
        group[active] = active[head][np.cumsum(new) - 1]
        alone = np.diff(np.append(head, len(p))) == 1
        active = active[~alone[np.cumsum(new) - 1]]

    # stage 2: buckets of first bytes upwards; the larger-than-successor
    # suffixes of a bucket by the rank of their successor, then its type S
    rank = np.full(n + 1, -1, np.int64)
    large = np.flatnonzero(place & ~small)
    steps = (run_end - idx)[large]
    o = np.lexsort((steps, x[large]))
    large, steps = large[o], steps[o]
    cut = np.flatnonzero(np.concatenate(([True], (x[large][1:] != x[large][:-1]) | (steps[1:] != steps[:-1])))) \
        if len(large) else np.zeros(0, np.int64)
    cut = np.append(cut, len(large))
    s_cut = np.searchsorted(x[pos], np.arange(257))
    order, done, g = [], 0, 0
    for c in range(256):
        while g < len(cut) - 1 and x[large[cut[g]]] == c:
            part = large[cut[g]:cut[g + 1]]
            after = np.where(part + 1 < end[part], rank[part + 1], -1)
            part = part[np.argsort(after, kind="stable")]
            rank[part] = np.arange(done, done + len(part))
            done += len(part)
            order.append(part)
            g += 1
        part = pos[s_cut[c]:s_cut[c + 1]]
        if len(part):
            rank[part] = np.arange(done, done + len(part))
            done += len(part)
            order.append(part)
    sa = np.concatenate(order) if order else np.zeros(0, np.int64)
    sa = sa[sa <= last[owner[sa]]]
    return sa, common_prefixes(sa, word, window)


def common_prefixes(sa: np.ndarray, word, window: int) -> np.ndarray:
    """Common prefix, up to ``window``, of each suffix with the one before."""
    lcp = np.zeros(len(sa), np.int64)
    live = np.arange(1, len(sa))
    for d in range(-(-window // 8)):
        if not len(live):
            break
        diff = word(sa[live], d) ^ word(sa[live - 1], d)
        same = diff == 0
        lead = np.zeros(len(live), np.int64)
        lead[same] = 8
        rest = diff[~same]
        zeros = np.zeros(len(rest), np.int64)
        for b in range(1, 8):
            zeros += (rest >> _U(64 - 8 * b)) == 0
        lead[~same] = zeros
        lcp[live] += lead
        live = live[same]
    return np.minimum(lcp, window)


def repeats_of(rows: list, window: int):
    """Removed ranges (th, start, end) of distinct stretches (doc_id, th,
    start, bytes) by suffix sorting; the first of equal windows stays."""
    x = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
    size = np.array([len(r[3]) for r in rows])
    begin = np.concatenate(([0], np.cumsum(size)))
    sa, lcp = sort_suffixes(x, begin, window)
    if not len(sa):
        return
    group = np.cumsum(lcp < window) - 1
    docs = sorted({(r[0], r[1]) for r in rows})
    doc_rank = {d: k for k, d in enumerate(docs)}
    base = np.array([(doc_rank[(r[0], r[1])] << 32) + r[2] for r in rows], np.int64)
    owner = np.repeat(np.arange(len(rows)), size)
    place = base[owner] + (np.arange(len(x)) - begin[owner])
    head = np.flatnonzero(lcp < window)
    first = np.minimum.reduceat(place[sa], head)
    flag = np.zeros(len(x) + 1, bool)
    flag[sa[place[sa] != first[group]]] = True
    a = np.flatnonzero(flag[:-1] & ~np.concatenate(([False], flag[:-2])))
    b = np.flatnonzero(flag[:-1] & ~flag[1:])
    for s, e in zip(a, b):
        k = owner[s]
        at = rows[k][2] - begin[k]
        yield rows[k][1], int(at + s), int(at + e + window)


def find_repeats(window: int, chunk_bytes: int):
    """Streams stretches in the order of (anchor, content, document, start)."""
    schema = pa.schema([("th", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])

    def emit(found):
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

    def run(batches):
        held, held_bytes, found = [], 0, []
        anchor = content = None
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("anchor", "doc_id", "th", "start", "length", "content")]
            for a, doc, th, start, length, c in zip(*cols):
                if c is None:
                    found.append((th, start, start + length))
                    continue
                if a != anchor:
                    if held_bytes > chunk_bytes:
                        found.extend(repeats_of(held, window))
                        held, held_bytes = [], 0
                    anchor, content = a, None
                if c == content:
                    if (doc, th, start) != held[-1][:3]:       # else the same row again
                        found.append((th, start, start + length))
                    continue
                content = c
                held.append((doc, th, start, c))
                held_bytes += len(c)
            yield from emit(found)
            found = []
        if held:
            found.extend(repeats_of(held, window))
        yield from emit(found)
    return run


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,end:int>>"


def cut_text(window: int):
    """Apply the removed ranges: the first document of a text has those that
    were found, its copies lose everything."""
    def run(batches):
        for batch in batches:
            texts, ids, owner, found = (batch.column(c).to_pylist() for c in ("text", "doc_id", "owner", "ranges"))
            out = []
            for t, i, o, r in zip(texts, ids, owner, found):
                b = (t or "").encode("utf-8")
                spans = []
                if i != o and len(b) >= window:
                    spans = [(0, len(b))]
                else:
                    for x in sorted((y["start"], y["end"]) for y in r or ()):
                        if spans and x[0] <= spans[-1][1]:
                            spans[-1] = (spans[-1][0], max(spans[-1][1], x[1]))
                        else:
                            spans.append(x)
                kept, at = hashlib.sha256(), 0
                for s, e in spans:
                    kept.update(b[at:s])
                    at = e
                kept.update(b[at:])
                out.append((i if i != _LAST else None, len(b), sum(e - s for s, e in spans), len(spans), kept.hexdigest(),
                            [{"start": s, "end": e} for s, e in spans]))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
            cols = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])
    return run


_LAST = (1 << 63) - 1


def wanted_anchors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Saved (th, anchors): the anchors of each text that occur elsewhere."""
    every = saved(docs.select("th", "text").mapInArrow(trimmed(anchors(window, gram)), "anchor long, th long, twice boolean"), "all-anchors")
    twice = (every.groupBy("anchor").agg(F.min("th").alias("lo"), F.max("th").alias("hi"),
                                         F.max(F.col("twice").cast("int")).alias("t"))
             .filter("lo <> hi OR t = 1").select("anchor"))
    both = every.select("anchor", "th").join(twice, "anchor")
    out = saved(both.groupBy("th").agg(F.collect_set("anchor").alias("anchors")), "anchors")
    drop(every)
    return out


def repeated_ranges(docs: DataFrame, owners: DataFrame, wanted: DataFrame, window: int, gram: int,
                    chunk_bytes: int) -> DataFrame:
    """Saved (th, ranges): the removed ranges of the first document of a text."""
    texts = docs.join(wanted.join(owners, "th"), "th").filter("doc_id = owner").select("doc_id", "th", "text", "anchors")
    parts = texts.mapInArrow(trimmed(stretches(window, gram)), STRETCH)
    found = (parts.repartition("anchor").sortWithinPartitions("anchor", "content_hash", "doc_id", "th", "start")
             .mapInArrow(trimmed(find_repeats(window, chunk_bytes)), "th long, start int, end int"))
    return saved(found.groupBy("th").agg(F.collect_list(F.struct("start", "end")).alias("ranges")), "ranges")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW,
                   gram: int = GRAM, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) per row."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    docs = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(_LAST)).alias("doc_id"), body.alias("text"),
                       F.xxhash64(body).alias("th"))
    owners = saved(docs.groupBy("th").agg(F.min("doc_id").alias("owner")), "owners")
    wanted = wanted_anchors(docs, window, gram)
    release(spark)
    ranges = repeated_ranges(docs, owners, wanted, window, gram, chunk_bytes)
    drop(wanted)
    release(spark)
    return (docs.join(owners.join(ranges, "th", "left"), "th")
            .select("doc_id", "owner", "text", "ranges").mapInArrow(cut_text(window), RESULT))


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).drop("spans")
