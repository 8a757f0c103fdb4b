"""Language-model scores by prediction by partial matching (PPM).

What is scored is the token stream of a text: its words
``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, each followed by a blank, and
one end symbol - so every token sequence is one string of symbols.  The model
is pretrained on the training part of the corpus:

 1. texts are packed into blocks of about ``BODY`` bytes.  A block sends each
    distinct string of ``ORDER`` context bytes and the next symbol once, with
    its count in the block's training texts, to the bucket of its nearest
    ``LOW + 1`` context bytes;
 2. every context that occurs in the training part is a node of a byte-context
    trie of orders 0 to ``ORDER``, so the model grows with the corpus.  All
    strings of a context of more than ``LOW`` bytes are in one bucket, whose
    task adds up the counts of the blocks and builds this part of the trie.
    Orders up to ``LOW`` are broadcast whole: their number is bounded by the
    alphabet (256**LOW contexts), not by a rule;
 3. a symbol is predicted by the longest context that is a node.  If it was
    not seen there, an escape (method D: half a count of every distinct symbol)
    leads to the next shorter context, in which the symbols of the longer one
    are excluded; below order 0 the unseen symbols are equally
    likely.  As this depends only on the context and the symbol, a bucket
    evaluates each distinct string once and sends the result back to the blocks
    that have it.

No phase holds more than a block's texts or the distinct strings of a bucket,
however large the corpus:  a bucket's strings wait for its trie on disk, and
texts, results and word counts meet by block as rows of at most a few hundred
KB (a longer text is one row), sorted and read one after the other.

The base score, from counts of whole tokens, needs the exact count of every
word: blocks send their distinct words, not their tokens, to the shuffle and
get the counts back.  Words are identified by a 64-bit hash.

With ``mass_bits`` (not set in the query), only contexts with at least
``2**-mass_bits`` of all training symbols are nodes.

Defined results: a null or empty text is the end symbol alone; a null doc_id
belongs to the training part; repeated rows are scored (and learnt from) each;
extra columns are ignored; with an empty training part every symbol has the
probability 1/257 and no token is known.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import LOWER, blocks, mix, text_views, trimmed, word_hashes, words
from ._store import arrow_batches, drop, release, saved, setting

ORDER, LOW, SYMBOLS, END = 5, 2, 257, 256
BLOCK = 384 << 10            # bytes of text worked on at once
BODY = 6 << 20              # bytes of text whose distinct strings and words are counted together, of a batch at most
BATCH_BYTES = 4 << 20        # handed to Python at once: one block
MERGE_KEYS = 1 << 18         # distinct strings or words gathered before they are merged
SPOOL_BYTES = 16 << 20       # of a bucket's strings held in memory; more wait on disk
LOGS_BYTES = 1 << 20         # of results handed back at once
ROWS_READ = 8                # rows of a block each that Spark reads at once
PASSES = 3                   # parts of the blocks whose texts meet their strings' results one after the other
BUCKET_BYTES, MIN_BUCKETS = 4 << 20, 512    # bytes of text for each bucket of strings
_U = np.uint64


def symbols(raw: np.ndarray, off: np.ndarray, starts, ends, first):
    """Token stream of a block: symbols (uint16) and first symbol of each
    text (length texts + 1)."""
    n_docs, n_words = len(off) - 1, len(starts)
    done = np.concatenate(([0], np.cumsum(ends - starts)))   # word bytes before each word
    out = np.full(int(done[-1]) + n_words + n_docs, 32, np.uint16)
    ends_at = done[first[1:]] + first[1:] + np.arange(n_docs)
    of_words = np.ones(len(out), bool)                       # all but the blank after each word and the ends
    of_words[done[1:] + np.arange(n_words) + np.repeat(np.arange(n_docs), np.diff(first))] = False
    of_words[ends_at] = False
    out[of_words] = (raw + ((raw - np.uint8(65)) < 26) * np.uint8(32))[(raw != 32) & ((raw - np.uint8(9)) > 4)]
    out[ends_at] = END
    return out, np.concatenate(([0], ends_at + 1))


def strings(sym: np.ndarray, begin: np.ndarray, order: int, low: int = 9, bits: int = 8) -> np.ndarray:
    """For every symbol, its context (``bits`` each, nearest byte first, 0
    before the text) in the high bits and the symbol in the ``low`` bits."""
    byte, out = (sym & ((1 << bits) - 1)).astype(_U), sym.astype(_U)
    for j in range(1, order + 1):
        out[j:] |= byte[:-j] << _U(low + bits * (order - j))
    for j in range(order):                                   # near its begin, a text has only ``j`` symbols before
        at, free = begin[:-1][np.diff(begin) > j] + j, _U(low + bits * (order - j))
        out[at] = out[at] >> free << free | sym[at]
    return out


def ranked(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of keys of ``bits`` bits, each run sorted by itself: the distinct
    keys of each; then for each place its position in ``keys``, and whether a
    distinct key begins there.  Key and position are sorted as one number, so
    a run is as long as the bits allow that a key leaves."""
    n = len(keys)
    run = min(n, 1 << 64 - bits)
    x = np.full(-(-n // run) * run, ~_U(0))
    np.left_shift(keys, _U(64 - bits), out=x[:n])
    x[:n] |= np.arange(n, dtype=_U) % _U(run)
    x.reshape(-1, run).sort(axis=1)                          # what fills the last run stays at its end
    x = x[:n]
    place = (x & _U((1 << 64 - bits) - 1)).astype(np.int32)
    for i in range(run, n, run):
        place[i:i + run] += i
    x >>= _U(64 - bits)
    new = np.ones(n, bool)
    new[1:] = x[1:] != x[:-1]
    new[::run] = True
    return x[new], place, new


class Alphabet:
    """The symbols of a block by their rank: its strings in fewer bits, in the
    same order."""

    def __init__(self, raw: np.ndarray):
        there = np.zeros(SYMBOLS, bool)
        for i in range(0, len(raw), BLOCK):
            there[LOWER[raw[i:i + BLOCK]]] = True
        there[[0, 32, END]] = True                           # before a text, after a word, after a text
        self.symbols = np.flatnonzero(there)
        self.rank = (np.cumsum(there) - 1).astype(np.uint16)
        self.bits = int(len(self.symbols) - 1).bit_length()

    def strings(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Strings, as ``strings`` gives them, of those of ranks."""
        mask, full = _U((1 << self.bits) - 1), self.symbols.astype(_U)
        out = full[keys & mask]
        for j in range(order):
            out |= full[keys >> _U(self.bits * (j + 1)) & mask] << _U(9 + 8 * j)
        return out


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[head], np.add.reduceat(counts, head) if len(head) else counts


class Running:
    """Distinct keys with the sums of their counts, merged whenever what has
    come since is as much as what is held: the memory is that of the distinct
    keys, not of all that came."""

    def __init__(self, kind: type = np.int32):
        self.parts, self.fresh, self.size, self.kind = [], 0, 0, kind

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts.astype(self.kind)))
        self.fresh += len(keys)
        if self.fresh > max(self.size, MERGE_KEYS):
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            self.parts = [(np.zeros(0, _U), np.zeros(0, self.kind))]
        if len(self.parts) > 1:
            keys, counts = (np.concatenate(x) for x in zip(*self.parts))
            self.parts = []
            keys, counts = summed(keys, counts)
            self.parts = [(keys, counts.astype(self.kind))]
        self.size, self.fresh = len(self.parts[0][0]), 0
        return self.parts[0]


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with their counts."""
    keys = np.sort(keys)
    head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[head], np.diff(np.append(head, len(keys)))


def level(keys: np.ndarray, counts: np.ndarray, order: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries (context << 9 | symbol) of order ``k`` and their counts."""
    return summed(((keys >> _U(9 + 8 * (order - k))) << _U(9)) | (keys & _U(511)), counts)


def buckets_of(keys: np.ndarray, order: int, n: int) -> np.ndarray:
    """Bucket of each string: a hash of its nearest ``LOW + 1`` context bytes."""
    near = keys >> _U(9 + 8 * max(0, order - LOW - 1))
    head = np.flatnonzero(np.concatenate(([True], near[1:] != near[:-1]))) if len(near) else np.zeros(0, np.int64)   # strings come sorted
    bucket = (mix(near[head]) % _U(n)).astype(np.uint16 if n <= 1 << 16 else np.int64)       # the short kind sorts faster
    return np.repeat(bucket, np.diff(np.append(head, len(near))))


def parts_of(raw: np.ndarray, off: np.ndarray):
    """Runs of texts of at most ``BLOCK`` bytes: (first row, end row, bytes, offsets)."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + BLOCK, "right")) - 1)
        yield i, j, raw[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


class Trie:
    """Nodes and entries of orders as sorted arrays; ``add`` appends the next
    order.  ``base``: a trie whose orders are shared."""

    NAMES = ("entries", "counts", "nodes", "total", "kinds", "shadow")

    def __init__(self, order: int, base: Trie | None = None):
        self.order = order
        for name in self.NAMES:
            setattr(self, name, list(getattr(base, name)) if base else [])

    def add(self, e: np.ndarray, c: np.ndarray, least: float = 0) -> None:
        """Entries, sorted, and their counts; contexts with a total below ``least`` are left out."""
        ctx = e >> _U(9)
        head = np.flatnonzero(np.concatenate(([True], ctx[1:] != ctx[:-1]))) if len(e) else np.zeros(0, np.int64)
        total = np.add.reduceat(c, head) if len(head) else c
        if len(head) and (total < least).any():
            use = np.repeat(total >= least, np.diff(np.append(head, len(e))))
            return self.add(e[use], c[use])
        self.entries.append(e)
        self.counts.append(c)
        self.nodes.append(ctx[head])
        self.total.append(total)
        self.kinds.append(np.diff(np.append(head, len(e))))
        # count, in the next shorter context, of the symbols seen in this one
        k = len(self.entries) - 1
        if k == 0 or not len(e):
            self.shadow.append(np.zeros(len(head), np.int64))
        else:
            up = ((ctx >> _U(8)) << _U(9)) | (e & _U(511))
            at = np.searchsorted(self.entries[k - 1], up)
            self.shadow.append(np.add.reduceat(self.counts[k - 1][at], head))

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of the last symbol of each string."""
        out = np.zeros(len(keys))
        todo = np.ones(len(keys), bool)
        sym = keys & _U(511)
        ex_n = np.zeros(len(keys), np.int64)
        ex_q = np.zeros(len(keys), np.int64)
        for k in range(self.order, -1, -1):
            if not len(self.nodes[k]):
                continue
            ctx = keys >> _U(9 + 8 * (self.order - k))
            at = np.minimum(np.searchsorted(self.nodes[k], ctx), len(self.nodes[k]) - 1)
            live = np.flatnonzero(todo & (self.nodes[k][at] == ctx))
            at = at[live]
            total = self.total[k][at] - ex_n[live]
            kinds = self.kinds[k][at] - ex_q[live]
            want = (ctx[live] << _U(9)) | sym[live]
            e = np.minimum(np.searchsorted(self.entries[k], want), len(self.entries[k]) - 1)
            seen = self.entries[k][e] == want
            gain = np.where(seen, self.counts[k][e] - 0.5, 0.5 * kinds)
            use = seen | (kinds > 0)
            out[live[use]] += np.log10(gain[use] / total[use])
            todo[live[seen]] = False
            ex_n[live], ex_q[live] = self.shadow[k][at], self.kinds[k][at]
        unseen = SYMBOLS - (int(self.kinds[0][0]) if len(self.nodes[0]) else 0)
        out[todo] -= np.log10(max(1, unseen))
        return out


BLOCK_ROW = ("block long, doc_id array<long>, held_out array<boolean>, n_bytes array<long>, body binary, "
             "low array<long>, low_n array<long>")
WORDS_ROW = "block long, words array<long>, train array<long>"


def one_list(x, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind))


def pack_blocks(text: str, low: int):
    """One row per block of texts, with the strings of ``low`` context bytes
    and their counts in the block's training texts."""
    def run(batches):
        for batch in batches:
            ids, flags = batch.column("doc_id"), batch.column("held_out").to_numpy(zero_copy_only=False)
            for i, j, raw, off in blocks(batch.column(text), BODY):
                held, grams = flags[i:j], Running()
                for a, b, part, po in parts_of(raw, off):
                    sym, begin = symbols(part, po, *words(part, po))
                    grams.add(*counted(strings(sym, begin, low)[~np.repeat(held[a:b], np.diff(begin))]))
                grams, gram_n = grams.merge()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uuid.uuid4().int >> 65], pa.int64()), one_list(ids.slice(i, j - i), pa.int64()),
                     one_list(held, pa.bool_()), one_list(np.diff(off), pa.int64()), pa.array([raw.tobytes()], pa.binary()),
                     one_list(grams.view(np.int64), pa.int64()), one_list(gram_n, pa.int64())],
                    names=[c.split()[0] for c in BLOCK_ROW.split(", ")])
    return run


def unpack(batch, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, held out) of the texts of a block."""
    raw = np.frombuffer(batch.column("body")[r].as_buffer(), np.uint8)
    off = np.concatenate(([0], np.cumsum(batch.column("n_bytes")[r].values.to_numpy())))
    return raw, off, batch.column("held_out")[r].values.to_numpy(zero_copy_only=False)


TEXT, LOGS, COUNTS = 0, 1, 2         # kinds of rows of a block
TEXT_ROW = "block long, kind int, place int, doc_id array<long>, held_out array<boolean>, n_bytes array<long>, body binary"


def cut_blocks(batches):
    """The texts of a block in rows of at most ``BLOCK`` bytes, to be dealt: a
    row of megabytes is copied whole, several times, by each step in the JVM."""
    for batch in batches:
        for r in range(batch.num_rows):
            raw, off, held = unpack(batch, r)
            ids = batch.column("doc_id")[r].values
            for k, (a, b, part, po) in enumerate(parts_of(raw, off)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("block").slice(r, 1), pa.array([TEXT], pa.int32()), pa.array([k], pa.int32()),
                     one_list(ids.slice(a, b - a), pa.int64()), one_list(held[a:b], pa.bool_()),
                     one_list(np.diff(po), pa.int64()), pa.array([part.tobytes()], pa.binary())],
                    names=[c.split()[0] for c in TEXT_ROW.split(", ")])


def flat(column: pa.ChunkedArray) -> pa.Array:
    """Elements of a column of lists; a null is an empty list."""
    return pa.concat_arrays([x.flatten() for x in column.chunks] or [pa.array([], column.type.value_type)])


def block_words(batches):
    """(block, words, train): the distinct words of a block and their counts
    in its training texts."""
    for batch in batches:
        for r in range(batch.num_rows):
            raw, off, held = unpack(batch, r)
            found = Running()
            for a, b, part, po in parts_of(raw, off):
                starts, ends, first = words(part, po)
                hashes, out = word_hashes(part, starts, ends), np.repeat(held[a:b], np.diff(first))
                found.add(*counted(hashes[~out]))
                late = counted(hashes[out])[0]
                found.add(late, np.zeros(len(late), np.int32))
            uniq, train = found.merge()
            yield pa.RecordBatch.from_arrays(
                [batch.column("block").slice(r, 1), one_list(uniq.view(np.int64), pa.int64()), one_list(train, pa.int64())],
                names=["block", "words", "train"])


def block_strings(order: int, n_buckets: int):
    """(bucket, block, keys, n): the distinct strings of a block, in the order
    of keys, and their counts in its training texts."""
    def cut(values, edge):
        return pa.Array.from_buffers(pa.binary(), len(edge) - 1, [
            None, pa.py_buffer((edge * values.itemsize).astype(np.int32)), pa.py_buffer(values)])

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                raw, off, held = unpack(batch, r)
                found = Running()
                for a, b, part, po in parts_of(raw, off):
                    sym, begin = symbols(part, po, *words(part, po))
                    keys, out = strings(sym, begin, order), np.repeat(held[a:b], np.diff(begin))
                    found.add(*counted(keys[~out]))
                    late = counted(keys[out])[0]
                    found.add(late, np.zeros(len(late), np.int32))
                keys, n = found.merge()
                del found
                bucket = buckets_of(keys, order, n_buckets)
                by = np.argsort(bucket, kind="stable")
                bucket, keys, n = bucket[by], keys[by], n[by]
                head = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
                edge = np.append(head, len(keys))
                block = batch.column("block")[r].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[head], pa.int32()), pa.array(np.full(len(head), block), pa.int64()),
                     cut(keys, edge), cut(n, edge)], names=["bucket", "block", "keys", "n"])
    return run


def score_strings(order: int, low, least: float):
    """(block, bucket, logs): log10 probabilities of the strings of each row.
    Rows come in the order of buckets.  A bucket is gone through twice, first
    for the counts, then for the results: between, its distinct strings are in
    memory, the rows in a file from ``SPOOL_BYTES`` on."""
    def scored(bucket, sizes, found, spool):
        uniq, total = found.merge()
        trie = Trie(order, low.value)
        for k in range(LOW + 1, order + 1):
            trie.add(*level(uniq[total > 0], total[total > 0], order, k), least)
        each = np.concatenate([trie.log10(uniq[i:i + MERGE_KEYS]) for i in range(0, len(uniq), MERGE_KEYS)])
        spool.seek(0)
        i, done = 0, np.cumsum([n for _, n in sizes])
        while i < len(sizes):
            before = done[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(done, before + LOGS_BYTES // 8, "right")))
            logs = each[np.searchsorted(uniq, np.frombuffer(spool.read(int(done[j - 1] - before) * 8), _U))]
            edge = np.append(0, done[i:j] - before) * 8
            yield pa.RecordBatch.from_arrays(
                [pa.array([block for block, _ in sizes[i:j]], pa.int64()), pa.array(np.full(j - i, bucket), pa.int32()),
                 pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(logs)])],
                names=["block", "bucket", "logs"])
            i = j

    def run(batches):
        at, sizes, found, spool = None, [], None, None
        for batch in batches:
            keys, n = batch.column("keys"), batch.column("n")
            for r, (bucket, block) in enumerate(zip(batch.column("bucket").to_pylist(), batch.column("block").to_pylist())):
                if bucket != at:
                    if sizes:
                        yield from scored(at, sizes, found, spool)
                        spool.close()
                    at, sizes, found, spool = bucket, [], Running(np.int64), tempfile.SpooledTemporaryFile(SPOOL_BYTES)
                here = np.frombuffer(keys[r].as_buffer(), _U)
                spool.write(here)
                sizes.append((block, len(here)))
                found.add(here.copy(), np.frombuffer(n[r].as_buffer(), np.int32))   # a view would keep its batch
        if sizes:
            yield from scored(at, sizes, found, spool)
            spool.close()
    return run


def low_orders(packed: DataFrame, order: int, mass_bits: int | None) -> tuple[Trie, float]:
    """The trie of orders up to ``LOW``, and the least total of a node."""
    got = (packed.select(F.explode(F.arrays_zip("low", "low_n")).alias("x"))
           .groupBy(F.col("x.low").alias("key")).agg(F.sum("x.low_n").alias("n")).toArrow())   # <= 257 * 256**LOW
    keys, n = got.column("key").to_numpy().view(_U), got.column("n").to_numpy().astype(np.int64)
    least, top = (int(n.sum()) / 2 ** mass_bits if mass_bits is not None else 0), min(order, LOW)
    trie = Trie(order)
    for k in range(top + 1):
        trie.add(*level(keys, n, top, k), least)
    return trie, least


RESULT = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
          "base_score double, score double")


def score_texts(order: int, n_buckets: int, tokens: int, kinds: int, ends: int):
    """Scores of the texts of a block from those of its strings and the counts
    of its words.  Rows come in the order of block, kind and place."""
    whole = tokens + 0.5 * (kinds + 1)

    def scored(rows):
        rows = pa.Table.from_batches(rows)
        part = np.searchsorted(rows["kind"].to_numpy(), [TEXT, LOGS, COUNTS, COUNTS + 1])
        texts, logs, known_words = (rows.slice(a, b - a) for a, b in zip(part[:-1], part[1:]))
        raw, off = text_views(texts["body"])[0], np.concatenate(([0], np.cumsum(flat(texts["n_bytes"]).to_numpy())))
        held = flat(texts["held_out"]).to_numpy(zero_copy_only=False)
        found, hashes, per_doc, abc = [], [], [], Alphabet(raw)
        width = abc.bits * (order + 1)
        for _, _, part, po in parts_of(raw, off):
            starts, ends_, first = words(part, po)
            hashes.append(word_hashes(part, starts, ends_))
            per_doc.append(np.diff(first))
            sym, begin = symbols(part, po, starts, ends_, first)
            found.append((*ranked(strings(abc.rank[sym], begin, order, abc.bits, abc.bits), width), begin))
        uniq = counted(np.concatenate([x[0] for x in found]))[0]
        log = np.empty(len(uniq))
        log[np.argsort(buckets_of(abc.strings(uniq, order), order, n_buckets), kind="stable")] = text_views(logs["body"])[0].copy().view(np.float64)
        score = []
        for keys, place, new, begin in found:
            each = np.empty(len(place))
            each[place] = np.repeat(log[np.searchsorted(uniq, keys)], np.diff(np.append(np.flatnonzero(new), len(new))))
            score.append(np.add.reduceat(each, begin[:-1]))
        del found, uniq, log
        word, which = np.unique(np.concatenate(hashes), return_inverse=True)
        per_doc, m = np.concatenate(per_doc), len(held)
        counts = np.zeros(len(word), np.int64)
        counts[flat(known_words["pos"]).to_numpy()] = flat(known_words["c"]).to_numpy()
        doc = np.repeat(np.arange(m), per_doc)
        base = np.bincount(doc, np.log10((counts + 0.5) / whole)[which], m)
        known = np.bincount(doc, (counts > 0)[which], m)
        return pa.RecordBatch.from_arrays(
            [flat(texts["doc_id"]), pa.array(held, pa.bool_()), pa.array(per_doc + 1, pa.int64()),
             pa.array((known + (ends > 0)).astype(np.int64)), pa.array(np.full(m, tokens, np.int64)),
             pa.array(base + np.log10((ends + 0.5) / whole)), pa.array(np.concatenate(score))],
            names=[c.split()[0] for c in RESULT.split(", ")])

    def run(batches):
        held, at = [], None
        for batch in batches:
            block = batch.column("block").to_numpy()
            edge = np.concatenate(([0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]))
            for a, b in zip(edge[:-1], edge[1:]):
                if a == b:
                    continue
                if block[a] != at and held:
                    yield scored(held)
                    held = []
                at = block[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield scored(held)
    return run


def word_counts(packed: DataFrame) -> tuple[DataFrame, int, int, int]:
    """Saved (block, pos, c) with the training count of each of the block's
    words, training tokens, distinct training tokens, training texts."""
    ends = packed.select(F.explode("held_out").alias("h")).agg(F.count(F.when(~F.col("h"), 1))).first()[0]
    with setting(packed.sparkSession, "spark.sql.parquet.columnarReaderBatchSize", str(ROWS_READ)):
        found = saved(packed.select("block", "n_bytes", "held_out", "body").mapInArrow(trimmed(block_words), WORDS_ROW), "block-words")
    known = found.select(F.explode(F.arrays_zip("words", "train")).alias("x")).select(
        F.col("x.words").alias("word"), F.col("x.train").alias("train"))
    totals = saved(known.filter("train > 0").groupBy("word").agg(F.sum("train").alias("c")), "words")
    del known
    release(packed.sparkSession)
    n, kinds = totals.agg(F.sum("c"), F.count(F.lit(1))).first()
    back = found.select("block", F.posexplode("words").alias("pos", "word")).join(totals, "word")
    counts = saved(back.groupBy("block").agg(F.collect_list("pos").alias("pos"), F.collect_list("c").alias("c")), "counts")   # bounded by the block
    drop(found)
    drop(totals)
    release(packed.sparkSession)
    return counts, int(n or 0) + ends, int(kinds) + (ends > 0), ends


def score_documents(docs: DataFrame, order: int = ORDER, mass_bits: int | None = None) -> DataFrame:
    """Scores of (doc_id, text, held_out) rows; learns from those not held out."""
    spark = docs.sparkSession
    with arrow_batches(spark, BATCH_BYTES):
        packed = saved(docs.select("doc_id", "text", "held_out")
                       .mapInArrow(trimmed(pack_blocks("text", min(order, LOW))), BLOCK_ROW), "blocks")
    size = packed.agg(F.sum(F.expr("aggregate(n_bytes, 0L, (x, y) -> x + y)"))).first()[0] or 0
    n_buckets = max(MIN_BUCKETS, size // BUCKET_BYTES)
    with arrow_batches(spark, BATCH_BYTES):
        counts, n, kinds, ends = word_counts(packed)
        trie, least = low_orders(packed, order, mass_bits)
        low = spark.sparkContext.broadcast(trie)
        rows = packed.select("block", "n_bytes", "held_out", "body").mapInArrow(
            trimmed(block_strings(order, n_buckets)), "bucket int, block long, keys binary, n binary")
        with setting(spark, "spark.sql.parquet.columnarReaderBatchSize", str(ROWS_READ)):
            logs = saved(rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
                trimmed(score_strings(order, low, least)), "block long, bucket int, logs binary"), "logs")
        low.destroy()
        release(spark)                      # the strings' shuffle files go before the logs are dealt
        scores = []
        for part in range(PASSES):
            of = lambda table: table.filter(F.col("block") % PASSES == part)  # noqa: B023, E731
            texts = of(packed).select("block", "doc_id", "held_out", "n_bytes", "body").mapInArrow(trimmed(cut_blocks), TEXT_ROW)
            results = of(logs).select("block", F.lit(LOGS).alias("kind"), F.col("bucket").alias("place"), F.col("logs").alias("body"))
            known = of(counts).select("block", F.lit(COUNTS).alias("kind"), F.lit(0).alias("place"), "pos", "c")
            rows = texts.unionByName(results, True).unionByName(known, True).repartition("block").sortWithinPartitions("block", "kind", "place")
            with setting(spark, "spark.sql.parquet.columnarReaderBatchSize", str(ROWS_READ)):
                scores.append(saved(rows.mapInArrow(trimmed(score_texts(order, n_buckets, n, kinds, ends)), RESULT), "scores"))
            del texts, results, known, rows
            release(spark)                  # the texts, logs and counts of a pass are dealt only for it
    for table in (packed, logs, counts):
        drop(table)
    release(spark)
    return reduce(DataFrame.unionByName, scores)


def op2_ppm_scores(spark, sf_dir: str) -> DataFrame:
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(part == 1, F.lit(False)).alias("held_out"))
    return score_documents(docs)
