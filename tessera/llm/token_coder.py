"""Token-id files: a context-mixing range coder.

A group of documents is a row of the file: document ids, lengths, a header and
blocks of ``BLOCK_IDS`` ids (the last one what is left).  The next id of a block
is predicted by

* order 2: the id that last followed the two ids before it in this block,
* order 1: how often each id followed the id before it in the group,
* order 0: how often each id stands in the group.

The counts of orders 0 and 1 are the header, so every block starts from them
and from nothing else: blocks are coded and read independently, and each has its
CRC-32.  (Counted within a block alone, 4096 ids teach little: most of what
an id says about the next would be lost.)  An id seen after the one before it
is coded by order 1, another by the escape of that context and order 0.  Order
2 has a confidence for each context (how often in a row it was right), and for
each confidence the coder tracks how often the prediction came true, in strides
of some steps; this rate is its share of the interval of the next id, which
drives a range coder (64-bit registers, 32-bit output, carries).

Coding is sequential within a block, so the blocks of a group are coded
side by side: one step codes the next id of every block with array operations.
A writer knows all ids, so it works out the predictions of all steps at once
and only the range coder goes step by step.

Spark sorts the documents by id (range partitions), every task tokenizes and
codes its part in groups, and the rows are written as Parquet to the shared
folder in ascending order; reading decodes row by row.

Defined results: a null text is empty (its ids are the end id alone); null
doc_ids come first; rows of equal doc_id are ordered by their text hash and
repeated rows are kept; extra columns are ignored; an empty table gives an
empty file and result; a block whose checksum fails raises an error.
"""

from __future__ import annotations

import hashlib
import json
import operator
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.prefix import prefix_sums
from ..session import scratch_path
from ._bytes import blocks, mix, trimmed, words

_U = np.uint64
MAGIC = b"CMR3"
BLOCK_IDS = 4096
GROUP_IDS = 4_000_000        # ids coded side by side (documents are not split)
SLOTS = 2048                 # order-2 predictions of a block
CONF, RATE = 8, 5
STRIDE = 32                  # steps between two looks at the hit rates
LANES_AT_ONCE = 64           # lanes whose predictions are worked out at once when they are written
UNIT_BITS, PAIR_BITS, FINE_BITS = 5, 14, 9      # shares of order 2; frequencies of order 1; what order 0 adds
TOTAL_BITS = UNIT_BITS + PAIR_BITS + FINE_BITS
LEAST_PAIR = 4               # a pair met less often costs more in the header than it saves
MAX_KINDS = 1 << 22          # distinct ids of a group
END_ID = 1
_WORD = _U(1 << 32)
_MOST = _U((1 << TOTAL_BITS) - 1)


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers, the low bytes of each first, compressed."""
    planes = [struct.pack("<I", len(a)) + a.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes() for a in arrays]
    return zlib.compress(b"".join(planes), 6)


def _unpacked(data: bytes) -> list[np.ndarray]:
    data, out, at = zlib.decompress(data), [], 0
    while at < len(data):
        n, = struct.unpack_from("<I", data, at)
        planes = np.frombuffer(data, np.uint8, 8 * n, at + 4).reshape(8, n)
        out.append(np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.int64))
        at += 4 + 8 * n
    return out


def _heads(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)


class Prior:
    """What the blocks of a group start from: the counts of ids and of pairs
    in the header, and the intervals that follow from these."""

    def __init__(self, header: bytes):
        gaps, counts, pair_gaps, n = _unpacked(header)
        self.header, self.alphabet = header, np.cumsum(gaps)
        kinds = self.kinds = len(self.alphabet)
        # order 0: at least 1 each, the rest by the counts
        self.fine = max(17, kinds.bit_length() + 1)
        f0 = 1 + counts * ((1 << self.fine) - kinds) // max(1, int(counts.sum()))
        f0[counts.argmax()] += (1 << self.fine) - f0.sum()
        self.cum0 = np.concatenate(([0], np.cumsum(f0)))
        # order 1: the pairs of each context, then its escape; the last context is the start of a block
        key = np.cumsum(pair_gaps)
        context, follower = np.divmod(key, kinds)
        known = np.bincount(context, n, kinds).astype(np.int64)
        least = min(1 << PAIR_BITS, 1 << max(8, self.fine - FINE_BITS))
        unknown = (np.maximum(counts - known, 0) << PAIR_BITS) // np.maximum(counts, 1)
        room = (1 << PAIR_BITS) - np.clip(unknown, least, 1 << PAIR_BITS)
        kept = np.bincount(context, minlength=kinds)
        used = (room >= 2 * kept)[context]
        key, context, follower, n, kept = key[used], context[used], follower[used], n[used], kept[context[used]]
        f1 = 1 + n * (room[context] - kept) // known[context]
        total = np.bincount(context, f1, kinds + 1).astype(np.int64)
        self.total = total                                              # where the escape of a context begins
        before, head = np.cumsum(f1) - f1, _heads(context)
        start = before - np.repeat(before[head], np.diff(np.append(head, len(context))))
        self.pair_key, self.pair_start, self.pair_size = key, start.astype(np.int32), f1.astype(np.int32)

    def index(self) -> "Prior":
        """For reading: all intervals of order 1, the first of each of some
        even parts of each context (two parts an interval or more), and the id
        at each place of order 0."""
        kinds, places = self.kinds, 1 << PAIR_BITS
        context, follower = np.divmod(self.pair_key, kinds)
        begin = np.concatenate([context * places + self.pair_start, np.arange(kinds + 1) * places + self.total])
        order = np.argsort(begin, kind="stable")
        kind = np.int32 if kinds < 1 << 16 else np.int64                # half the memory to look into
        self.begin = begin[order].astype(kind)
        end = begin + np.append(self.pair_size, places - self.total)
        follower = np.append(follower, np.full(kinds + 1, -1))
        self.packed = (follower << 2 * PAIR_BITS + 2 | begin % places << PAIR_BITS + 1 | end - begin // places * places)[order]
        n = np.bincount(begin // places)
        bits = np.minimum(np.ceil(np.log2(2 * n)).astype(np.int64), PAIR_BITS)
        parts = 1 << bits
        at = np.cumsum(parts) - parts
        context = np.repeat(np.arange(kinds + 1), parts)
        place = (np.arange(len(context)) - at[context]) << (PAIR_BITS - bits)[context]
        self.first = (self.begin.searchsorted((context * places + place).astype(kind), "right") - 1).astype(np.int32)
        self.part = at << 4 | PAIR_BITS - bits
        self.symbol0 = np.repeat(np.arange(kinds, dtype=np.int32), np.diff(self.cum0))
        return self

    def found(self, a: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Follower (-1: the escape), begin and size of the interval of each
        context that holds a place in it."""
        part = self.part.take(a)
        at = self.first.take((part >> 4) + (place >> (part & 15)))
        got = self.packed.take(at)
        later = (place >= (got & ((2 << PAIR_BITS) - 1))).nonzero()[0]
        if len(later):                                   # mostly in the next one
            want, near = place.take(later), self.packed.take(at.take(later) + 1)
            far = (want >= (near & ((2 << PAIR_BITS) - 1))).nonzero()[0]
            if len(far):
                key = (a.take(later.take(far)).astype(self.begin.dtype) << PAIR_BITS) + want.take(far)
                near[far] = self.packed.take(self.begin.searchsorted(key, "right") - 1)
            got[later] = near
        low = got.astype(np.int32)
        begin = (low >> PAIR_BITS + 1) & ((1 << PAIR_BITS) - 1)
        return (got >> 2 * PAIR_BITS + 2).astype(np.int32), begin, (low & ((2 << PAIR_BITS) - 1)) - begin

    @classmethod
    def of(cls, ids: np.ndarray) -> tuple["Prior", np.ndarray, np.ndarray]:
        """The prior of a group, the place of each id in its alphabet, and for
        each id but the first the interval of order 1 that it and the id
        before it have (-1: none)."""
        if int(ids.max()) < MAX_KINDS:
            counts = np.bincount(ids)
            alphabet = np.flatnonzero(counts)
            place = np.zeros(len(counts), np.int32)
            place[alphabet] = np.arange(len(alphabet))
            x, counts = place[ids], counts[alphabet]
        else:
            alphabet, x, counts = np.unique(ids, return_inverse=True, return_counts=True)
            if len(alphabet) >= MAX_KINDS:
                raise ValueError(f"a group of documents has {MAX_KINDS} distinct ids or more")
        pairs = x[:-1].astype(np.int64) * len(alphabet) + x[1:]
        if len(alphabet) < 1 << 16 and len(pairs) < 1 << 32:              # a pair and its place in one number
            packed = np.sort(pairs.astype(_U) << _U(32) | np.arange(len(pairs), dtype=_U))
            order, ordered = (packed & _U(0xFFFFFFFF)).astype(np.int64), (packed >> _U(32)).astype(np.int64)
            del packed
        else:
            order = np.argsort(pairs)
            ordered = pairs[order]
        head = _heads(ordered)
        kind, n = ordered[head], np.diff(np.append(head, len(ordered)))
        keep = n >= np.maximum(LEAST_PAIR, counts[kind // len(alphabet)] >> PAIR_BITS - 2)   # a quarter of the intervals at most
        prior = cls(_packed(np.diff(alphabet, prepend=0), counts, np.diff(kind[keep], prepend=0), n[keep]))
        entry = np.full(len(kind), -1, np.int32)
        if len(prior.pair_key):
            at = np.minimum(np.searchsorted(prior.pair_key, kind), len(prior.pair_key) - 1)
            entry = np.where(prior.pair_key[at] == kind, at, -1).astype(np.int32)
        which = np.empty(len(pairs), np.int32)
        which[order] = np.repeat(entry, n)
        return prior, x.astype(np.int32), which


class Recent:
    """Order 2 of many blocks, one lane each: per hashed context the id that
    last followed and its confidence (how often in a row it was right, 0: the
    context is new), and per confidence how often such predictions come true,
    brought up to date every ``STRIDE`` steps.

    ``known``: all ids (steps by lanes), when they are written; then one call
    of ``predict`` answers for all steps."""

    def __init__(self, lanes: int, known: np.ndarray | None = None):
        self.known, self.lanes = known, lanes
        self.rates = np.tile((np.arange(CONF) * 65536 * 7 // (8 * CONF)).astype(np.int32), lanes)
        self.shares = self.share()
        if known is None:
            self.table, self.step = np.zeros(lanes * SLOTS, np.int32), 0
            self.slots, self.kinds = (np.arange(lanes) * k for k in (SLOTS, CONF))     # 64-bit places: no copy to look them up
            self.rate_at, self.hits = np.zeros((STRIDE, lanes), np.int64), np.zeros((STRIDE, lanes), bool)

    def share(self) -> np.ndarray:
        """What each confidence is given, in units of 1/2**UNIT_BITS."""
        share = (self.rates * ((1 << UNIT_BITS) - 2)) >> 16
        share[::CONF] = 0
        return share

    def track(self, tries: np.ndarray, hits: np.ndarray) -> None:
        """A rate is that of the last predictions, about 2**RATE of them."""
        self.rates = (((self.rates << RATE) + (hits << 16)) // (tries + (1 << RATE))).astype(np.int32)
        self.shares = self.share()

    def predict(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Predicted ids, and their share in units of 1/2**UNIT_BITS."""
        slot = (a * 40503 + b * 30011) >> 3 & (SLOTS - 1)
        if self.known is not None:
            return self.foretold(slot.reshape(self.known.shape))
        self.at = slot + self.slots
        state = self.table.take(self.at)
        self.conf, self.said = state & (CONF - 1), state >> 3
        rate_at = self.rate_at[self.step]
        np.add(self.conf, self.kinds, out=rate_at)
        return self.said, self.shares.take(rate_at)

    def learn(self, x: np.ndarray) -> None:
        hit = np.equal(self.said, x, out=self.hits[self.step])
        self.table[self.at] = x << 3 | np.minimum(self.conf * hit + 1, CONF - 1)
        self.step += 1
        if self.step == STRIDE:
            size = len(self.rates)
            self.track(np.bincount(self.rate_at.ravel(), minlength=size), np.bincount(self.rate_at[self.hits], minlength=size))
            self.step = 0

    def foretold(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same predictions for ids that are known: what last stood in a
        slot is the one before in the order of slots and steps."""
        steps, lanes = slot.shape
        said, share = np.empty((steps, lanes), np.int32), np.empty((steps, lanes), np.int32)
        strides = -(-steps // STRIDE)
        stride_of = (np.arange(steps) // STRIDE)[:, None]
        for i in range(0, lanes, LANES_AT_ONCE):
            of = slice(i, min(lanes, i + LANES_AT_ONCE))
            n = of.stop - i
            s = np.ascontiguousarray(slot[:, of].T).astype(np.uint16)
            order = np.argsort(s, axis=1, kind="stable")
            order += np.arange(n)[:, None] * steps
            s, y = s.take(order).ravel(), np.ascontiguousarray(self.known[:, of].T).take(order).ravel()
            old = np.concatenate(([False], s[1:] == s[:-1]))
            old[::steps] = False                              # each lane by itself
            before = np.concatenate(([0], y[:-1])) * old
            hit = old & (before == y)
            place = np.arange(len(y), dtype=np.int32)
            missed = np.maximum.accumulate(np.where(hit, 0, place))
            run = place - np.concatenate(([0], missed[:-1]))  # steps since the last miss
            order = order.ravel()
            got = np.empty(len(y), np.int32)
            got[order] = before * (2 * CONF) + np.minimum(run, CONF - 1) * old * 2 + hit          # the three in one number
            got = np.ascontiguousarray(got.reshape(n, steps).T)
            said[:, of] = got // (2 * CONF)
            conf, hit = got // 2 & (CONF - 1), got & 1
            key = (stride_of * n + np.arange(n)) * CONF + conf
            tries, hits = (np.bincount(k, minlength=strides * n * CONF).reshape(strides, -1) for k in (key.ravel(), key[hit > 0]))
            rates = Recent(n, self.known)
            shares = np.empty((strides, n * CONF), np.int32)
            for k in range(strides):
                shares[k] = rates.shares
                rates.track(tries[k], hits[k])
            share[:, of] = shares.take(key)
        return said.ravel(), share.ravel()


def encode_lanes(prior: Prior, x: np.ndarray, which: np.ndarray, last: int) -> list[bytes]:
    """Code the columns of ``x`` (steps by lanes, places in the alphabet);
    ``which``: intervals of order 1; the last lane has only ``last`` ids."""
    steps, n = x.shape
    a = np.concatenate([np.full((1, n), prior.kinds, np.int32), x[:-1]])
    b = np.concatenate([np.full((1, n), prior.kinds, np.int32), a[:-1]])
    said, share = (v.reshape(steps, n) for v in Recent(n, x).predict(a.ravel(), b.ravel()))
    del b
    total, cum0 = prior.total.astype(np.int32), prior.cum0.astype(np.int32)
    size0 = np.diff(cum0)
    intervals = np.append(prior.pair_start << PAIR_BITS + 1 | prior.pair_size, np.int32(0))
    down = prior.fine - FINE_BITS
    low, rng = np.zeros(n, _U), np.full(n, _U(0xFFFFFFFFFFFFFFFF))
    out, to = np.zeros(n * (steps + 8), np.uint32), np.arange(n, dtype=np.int64) * (steps + 8)
    begin, ended = to.copy(), b""
    for t in range(steps):
        k = t % STRIDE
        if not k:
            # intervals of order 1 and 0; both are scaled by the share m that order 2 leaves
            of = slice(t, t + STRIDE)
            s, u, pair, before = x[of], share[of], which[of], total[a[of]]
            m, esc = (1 << UNIT_BITS) - u, pair < 0
            unit = ((m * ((1 << PAIR_BITS) - before)) >> down) * esc
            two = (said[of] == s) & (u > 0)
            interval = intervals.take(pair)
            starts = (u << PAIR_BITS + FINE_BITS) + m * (np.where(esc, before, interval >> PAIR_BITS + 1) << FINE_BITS) + unit * cum0.take(s)
            sizes = m * ((interval & ((2 << PAIR_BITS) - 1)) << FINE_BITS) + unit * size0.take(s)
            starts, sizes = np.where(two, 0, starts).astype(_U), np.where(two, u << PAIR_BITS + FINE_BITS, sizes).astype(_U)
        if t == last:
            ended = out[begin[-1]:to[-1]].tobytes() + struct.pack("<II", int(low[-1]) >> 32, int(low[-1]) & 0xFFFFFFFF)
        r = rng >> _U(TOTAL_BITS)
        new = low + starts[k] * r
        over = (new < low).nonzero()[0]
        if len(over):                                    # carry into the words already written
            j = to[over] - 1
            out[j] += np.uint32(1)
            for j in j[out[j] == 0]:
                while not out[j]:
                    j -= 1
                    out[j] += np.uint32(1)
        low, rng = new, sizes[k] * r
        idx = (rng < _WORD).nonzero()[0]
        if len(idx):
            lo, j = low[idx], to[idx]
            out[j] = lo >> _U(32)
            to[idx] = j + 1
            low[idx] = lo << _U(32)
            rng[idx] <<= _U(32)
    out[to] = low >> _U(32)
    out[to + 1] = low & _U(0xFFFFFFFF)
    coded = [out[i:j + 2].tobytes() for i, j in zip(begin.tolist(), to.tolist())]
    return coded if last == steps else coded[:-1] + [ended]


def decode_lanes(prior: Prior, payloads: list[bytes], steps: int) -> np.ndarray:
    """The inverse of ``encode_lanes`` (steps by lanes); what follows the end
    of a shorter block means nothing."""
    n = len(payloads)
    length = max(len(p) for p in payloads) // 4
    data = np.zeros((n, length + 4), np.uint32)
    for k, p in enumerate(payloads):
        data[k, :len(p) // 4] = np.frombuffer(p, np.uint32)
    flat, at = data.ravel(), np.arange(n, dtype=np.int64) * (length + 4) + 2
    diff = (data[:, 0].astype(_U) << _U(32)) | data[:, 1]       # code minus the interval's low end
    rng = np.full(n, _U(0xFFFFFFFFFFFFFFFF))
    recent, down = Recent(n), prior.fine - FINE_BITS
    cum0 = prior.cum0.astype(np.int32)
    f0 = np.diff(cum0)
    a = b = np.full(n, prior.kinds, np.int32)
    out = np.empty((steps, n), np.int32)
    for t in range(steps):
        said, u = recent.predict(a, b)
        m = (1 << UNIT_BITS) - u
        r = rng >> _U(TOTAL_BITS)
        v = np.minimum(diff // r, _MOST).astype(np.int32)
        skip = u << PAIR_BITS + FINE_BITS
        w = v - skip
        two = w < 0
        part = m << FINE_BITS
        s, start1, size1 = prior.found(a, (np.maximum(w, 0) / part).astype(np.int32))       # doubles are exact here
        start, size = skip + part * start1, part * size1
        esc = ((s < 0) & ~two).nonzero()[0]
        if len(esc):
            unit, from1 = (m.take(esc) * size1.take(esc)) >> down, start.take(esc)
            q = np.minimum(((v.take(esc) - from1) / unit).astype(np.int32), (1 << prior.fine) - 1)
            s0 = prior.symbol0.take(q)
            s[esc] = s0
            start[esc] = from1 + unit * cum0.take(s0)
            size[esc] = unit * f0.take(s0)
        two = two.nonzero()[0]
        s[two], start[two], size[two] = said.take(two), 0, skip.take(two)
        out[t] = s
        diff = diff - start.astype(_U) * r
        rng = size.astype(_U) * r
        small = rng < _WORD
        idx = small.nonzero()[0]
        if len(idx):
            diff[idx] = (diff.take(idx) << _U(32)) | flat.take(at.take(idx), mode="clip")
            at += small
            rng[idx] = rng.take(idx) << _U(32)
        recent.learn(out[t])
        a, b = out[t], a
    return out


_HEAD = struct.Struct("<4sI")


def encode(ids: np.ndarray) -> tuple[bytes, list[bytes]]:
    """(header, blocks) of a sequence of ids (0 and more)."""
    total = len(ids)
    if not total:
        return b"", []
    prior, places, pairs = Prior.of(ids)
    steps = min(total, BLOCK_IDS)
    lanes = -(-total // BLOCK_IDS)
    x, which = np.zeros(lanes * steps, np.int32), np.full(lanes * steps, -1, np.int32)
    x[:total], which[1:total] = places, pairs
    which[::steps] = -1                                  # a block begins with nothing before it
    columns = [np.ascontiguousarray(v.reshape(lanes, steps).T) for v in (x, which)]
    last = total - (lanes - 1) * BLOCK_IDS
    out = []
    for k, payload in enumerate(encode_lanes(prior, *columns, last)):
        head = _HEAD.pack(MAGIC, steps if k < lanes - 1 else last)
        out.append(head + struct.pack("<I", zlib.crc32(head + payload)) + payload)
    return prior.header, out


def decode(header: bytes, coded: list[bytes]) -> np.ndarray:
    """The ids of some blocks of a group, one after the other."""
    if not coded:
        return np.zeros(0, np.int64)
    counts, payloads = [], []
    for block in coded:
        magic, count = _HEAD.unpack_from(block)
        crc, = struct.unpack_from("<I", block, _HEAD.size)
        payload = block[_HEAD.size + 4:]
        if magic != MAGIC or crc != zlib.crc32(block[:_HEAD.size] + payload):
            raise ValueError("token block: wrong magic or checksum")
        counts.append(count)
        payloads.append(payload)
    prior = Prior(header).index()
    x = decode_lanes(prior, payloads, max(counts))
    return prior.alphabet[np.concatenate([x[:c, k] for k, c in enumerate(counts)])]


# ---- tokenizing -------------------------------------------------------------

_CACHE: dict = {}
_ID_OF = operator.attrgetter("id")
CACHE_WORDS = 1_500_000
NEAR = 1 << 18               # words met again and again that are found without a search
LONG_WORD = 64               # bytes; longer words are hashed one by one
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)
_PLAIN, _EXACT = _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F)


def lower_cased(raw: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased."""
    return raw + ((raw - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))


def byte_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: np.uint64) -> np.ndarray:
    """64-bit hash of every stretch of bytes, eight of its bytes at a time."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))       # the eight bytes from each place on
    size = ends - starts
    h = mix((eight[starts] & _MASKS[np.minimum(size, 8)]) + size.astype(_U) * seed)
    at, done = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
    while len(at):
        h[at] = mix(h[at] * _U(0x9E3779B97F4A7C15) + (eight[starts[at] + done] & _MASKS[np.minimum(size[at] - done, 8)]))
        done += 8
        at = at[size[at] > done]
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        h[k] ^= _U(int.from_bytes(hashlib.blake2b(raw[starts[k]:ends[k]], digest_size=8).digest(), "little"))
    return h


def spelling_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every word that tells apart what the tokenizer may: a
    word of ASCII and Latin-1 letters and of signs without A-Z and a-z being
    different, one that may hold a special token (these are case-sensitive,
    and begin with ``<``) or other letters (which may be composed before they
    are lower-cased) as it is."""
    if not len(starts):
        return np.zeros(0, _U)
    h = byte_hashes(lower_cased(raw), starts, ends, _PLAIN)
    aside = (raw == ord("<")) | (raw >= 0xC0) & (raw != 0xC3)
    if aside.any():
        of = np.flatnonzero(np.logical_or.reduceat(aside, starts))       # blanks between words count nothing
        h[of] = byte_hashes(raw, starts[of], ends[of], _EXACT)
    return h


def cut_out(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of bytes one after the other, a blank after each, and where
    each begins."""
    width = ends - starts + 1
    end = np.cumsum(width)
    out = raw.take(np.arange(int(width.sum())) + np.repeat(starts - (end - width), width), mode="clip")
    out[end - 1] = 32
    return out, end - width


# Letters of ASCII (those of Latin-1 are two bytes, the first is C3), then ASCII signs without ``<``:
# what ``PARTS_APART`` takes for two parts.
_BYTES = np.arange(256, dtype=np.uint8)
_LETTER = lower_cased(_BYTES) - np.uint8(97) < 26
_SIGN = (_BYTES > 32) & (_BYTES < 127) & ~_LETTER & (_BYTES - np.uint8(48) > 9) & (_BYTES != ord("<"))
PARTS_APART = (
    {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]})


def letters_signs(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the letters that a word begins with end, and whether nothing but
    signs follows; a byte that is no letter stands after each word."""
    letter = _LETTER[raw]
    lead = np.flatnonzero(raw == 0xC3)
    lead = lead[(raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]       # the signs for times and divided by
    letter[lead] = letter[lead + 1] = True
    other = np.flatnonzero(~letter)
    middle = other[np.searchsorted(other, starts)]
    signs = np.add.reduceat(_SIGN[raw], starts, dtype=np.int64)
    return middle, (middle > starts) & (signs == ends - middle)


class WordTokenizer:
    """Ids of texts from the ids of their words, for a tokenizer that never
    joins text across white space.  Words are told apart by a 64-bit hash
    (``spelling_hashes``); the ids of up to ``CACHE_WORDS`` words are
    remembered.  A word met again is looked for at one place first (``NEAR``
    places), then in the sorted hashes of all words.

    A tokenizer whose file has the rules ``PARTS_APART`` also takes letters
    and the signs after them for two parts.  Then a new word of letters and
    signs has the ids of these, which are remembered as words, and the model
    gets the letters as the rules would give them."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        self.model = None
        if (rules["normalizer"], rules["pre_tokenizer"]) == PARTS_APART and all(
                "<" in t["content"] and not (t["normalized"] or t["lstrip"] or t["rstrip"]) for t in rules["added_tokens"]):
            self.model = Tokenizer.from_file(path).model
            level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            # what the rules give for the bytes of lower-case letters of Latin-1, where that is not the byte's own sign
            self.shown = sorted({(x, y) for c in map(chr, range(0xDF, 0x100)) if c.isalpha()
                                 for x, y in zip(c.encode().decode("latin-1"), level.pre_tokenize_str(c)[0][0]) if x != y})
        self.clear()

    def clear(self):
        self.hashes, self.rows = np.zeros(0, _U), np.zeros(0, np.int32)      # sorted; the row of each
        # row 0 is the end of a text
        self.begin, self.size, self.table = np.zeros(1, np.int32), np.ones(1, np.int32), np.zeros(1, np.int32)
        self.near, self.near_row = ~np.arange(NEAR, dtype=_U), np.zeros(NEAR, np.int32)   # no hash has these at its place

    def known(self, hashes) -> np.ndarray:
        """Whether words are remembered."""
        if not len(self.hashes):
            return np.zeros(len(hashes), bool)
        return self.hashes[np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)] == hashes

    def row_of(self, hashes) -> np.ndarray:
        return self.rows[np.searchsorted(self.hashes, hashes)]

    def learn(self, hashes, raw, starts, ends):
        """Tokenize new words (sorted hashes); those of letters and signs by
        way of the two, which become words as well."""
        raw, at = cut_out(raw, starts, ends)
        starts, ends = at, at + (ends - starts)
        if self.model is None:
            return self.add(hashes, raw, starts, ends, np.zeros(len(hashes), bool))
        middle, letters = letters_signs(raw, starts, ends)
        two = letters & (middle < ends)
        if not two.any():
            return self.add(hashes, raw, starts, ends, letters)
        begin, end = (np.stack(v, 1).ravel() for v in ((starts[two], middle[two]), (middle[two], ends[two])))
        units = byte_hashes(lower_cased(raw), begin, end, _PLAIN)
        own, first = np.unique(units, return_index=True)
        new = ~self.known(own)
        alone = hashes[~two]                                 # the words without signs, and the letters that are none of them
        if len(alone):
            new &= alone[np.minimum(np.searchsorted(alone, own), len(alone) - 1)] != own
        first = first[new]
        found = np.concatenate([alone, own[new]])
        order = np.argsort(found)
        self.add(found[order], raw, np.concatenate([starts[~two], begin[first]])[order],
                 np.concatenate([ends[~two], end[first]])[order], np.concatenate([letters[~two], first % 2 == 0])[order])
        rows = self.row_of(units)
        size = self.size[rows].astype(np.int64)
        inner = np.arange(int(size.sum())) + np.repeat(self.begin[rows] - (np.cumsum(size) - size), size)
        self.insert(hashes[two], size[::2] + size[1::2], [self.table[inner]])

    def add(self, hashes, raw, starts, ends, letters):
        """Tokenize words, many per call: those of letters as the model takes
        them, others as one text that is split by the offsets."""
        size, parts = np.zeros(len(hashes), np.int64), []
        for of, fn in ((np.flatnonzero(letters), self.of_letters), (np.flatnonzero(~letters), self.of_text)):
            for i in range(0, len(of), 2000):
                k = of[i:i + 2000]
                ids, size[k] = fn(cut_out(raw, starts[k], ends[k])[0][:-1].tobytes().decode("utf-8").split(" "))
                parts.append(ids)
        order = np.concatenate([np.flatnonzero(letters), np.flatnonzero(~letters)])      # as the ids come
        begin = np.empty(len(hashes), np.int64)
        begin[order] = np.cumsum(size[order]) - size[order]
        self.insert(hashes, size, parts, begin)

    def of_letters(self, part):
        shown = " ".join(part).lower()
        if not shown.isascii():
            shown = shown.encode().decode("latin-1")
            for x, y in self.shown:
                shown = shown.replace(x, y)
        ids, n = [], []
        for tokens in map(self.model.tokenize, shown.split(" ")):      # one word's tokens live at a time
            n.append(len(tokens))
            ids.extend(map(_ID_OF, tokens))
        return np.array(ids, np.int32), np.array(n, np.int64)

    def of_text(self, part):
        edge = np.cumsum([len(t) + 1 for t in part])
        e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
        at = np.fromiter((o[0] for o in e.offsets), np.int64, len(e.ids))
        return np.array(e.ids, np.int32), np.diff(np.searchsorted(at, edge), prepend=0)

    def insert(self, hashes, size, parts, begin=None):
        """Remember words (sorted hashes) in rows after the others."""
        at, row = np.searchsorted(self.hashes, hashes), len(self.size)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.rows = np.insert(self.rows, at, np.arange(row, row + len(hashes), dtype=np.int32))
        begin = len(self.table) + (np.cumsum(size) - size if begin is None else begin)
        self.begin, self.size = (np.concatenate([v, x.astype(np.int32)]) for v, x in ((self.begin, begin), (self.size, size)))
        self.table = np.concatenate([self.table, *parts])

    def ids(self, raw: np.ndarray, off: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by ``end_id``; ids of each text)."""
        if len(self.hashes) > CACHE_WORDS:
            self.clear()
        self.table[0] = end_id
        starts, ends, first = words(raw, off)
        h = spelling_hashes(raw, starts, ends)
        place = (h & _U(NEAR - 1)).astype(np.int64)
        row = self.near_row.take(place)
        far = np.flatnonzero(self.near.take(place) != h)
        if len(far):
            order = far[np.argsort(h[far])]
            ordered = h[order]
            head = _heads(ordered)
            uniq, n = ordered[head], np.diff(np.append(head, len(ordered)))
            known = self.known(uniq)
            if not known.all():
                k = order[head[~known]]
                self.learn(uniq[~known], raw, starts[k], ends[k])
            rows = self.row_of(uniq)
            row[order] = np.repeat(rows, n)
            again = known | (n > 1)
            _, one = np.unique(place[order[head[again]]], return_index=True)      # one word a place
            one = np.flatnonzero(again)[one]
            at = place[order[head[one]]]
            self.near[at], self.near_row[at] = uniq[one], rows[one]
        n_docs = len(off) - 1
        row = np.insert(row, first[1:], 0)                   # the end of each text
        size = self.size.take(row)
        end = np.cumsum(size, dtype=np.int64)
        out = self.table.take(np.arange(int(end[-1]) if n_docs else 0) + np.repeat(self.begin.take(row) - (end - size), size))
        return out, np.diff(end[first[1:] + np.arange(n_docs)], prepend=0)


def word_tokenizer(path: str) -> WordTokenizer:
    if path not in _CACHE:
        _CACHE[path] = WordTokenizer(path)
    return _CACHE[path]


GROUP_KEY_BITS = 32          # groups of a partition
FILE_ROW = "group_key long, doc_id array<long>, n_tokens array<long>, header binary, blocks array<binary>"


def write_groups(path: str, end_id: int, group_ids: int):
    """Rows of the file from texts in ascending order of doc_id."""
    schema = pa.schema([("group_key", pa.int64()), ("doc_id", pa.list_(pa.int64())),
                        ("n_tokens", pa.list_(pa.int64())), ("header", pa.binary()), ("blocks", pa.list_(pa.binary()))])

    def row(key, docs, sizes, ids):
        docs = pa.concat_arrays(docs)
        header, coded = encode(np.concatenate(ids))
        return pa.RecordBatch.from_arrays(
            [pa.array([key], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs),
             pa.array([np.concatenate(sizes)], pa.list_(pa.int64())), pa.array([header], pa.binary()),
             pa.array([coded], pa.list_(pa.binary()))], schema=schema)

    def run(batches):
        tokenizer = word_tokenizer(path)
        key = TaskContext.get().partitionId() << GROUP_KEY_BITS       # partitions follow doc_id, groups their partition
        docs, sizes, ids, held = [], [], [], 0
        for batch in batches:
            doc_ids = batch.column("doc_id")
            for i, j, raw, off in blocks(batch.column("text"), 4 << 20):
                got, n = tokenizer.ids(raw, off, end_id)
                docs.append(doc_ids.slice(i, j - i))
                sizes.append(n)
                ids.append(got)
                held += len(got)
                if held >= group_ids:
                    yield row(key, docs, sizes, ids)
                    docs, sizes, ids, held, key = [], [], [], 0, key + 1
        if docs:
            yield row(key, docs, sizes, ids)
    return run


READ_ROW = "group_key long, doc_id long, at long, n_tokens long, ids_crc32 long"


def read_groups(batches):
    """Per document: position in the group, number and checksum of its ids."""
    for batch in batches:
        for r in range(batch.num_rows):
            ids = decode(batch.column("header")[r].as_py(), batch.column("blocks")[r].as_py()).astype("<u4")
            docs, n = batch.column("doc_id")[r].values, batch.column("n_tokens")[r].values.to_numpy()
            end = np.cumsum(n)
            data = memoryview(ids.tobytes())
            crc = [zlib.crc32(data[4 * (e - k):4 * e]) for e, k in zip(end.tolist(), n.tolist())]
            m = len(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.column("group_key")[r].as_py()] * m, pa.int64()), docs, pa.array(end - n),
                 pa.array(n), pa.array(crc, pa.int64())], names=[c.split()[0] for c in READ_ROW.split(", ")])


def write_ids(docs: DataFrame, tokenizer_path: str, out: str, doc_id: str = "doc_id", text: str = "text",
              end_id: int = END_ID, group_ids: int = GROUP_IDS) -> None:
    """Write the token ids of ``docs`` in ascending order of doc_id."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("_h"))
    (rows.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h").select("doc_id", "text")
     .mapInArrow(trimmed(write_groups(tokenizer_path, end_id, group_ids)), FILE_ROW).write.parquet(out))


def read_ids(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files: ``start`` counts
    the ids of all documents before it."""
    file = spark.read.schema(FILE_ROW).parquet(path)
    # one row a group of documents; summed within each partition first
    size = file.select("group_key", F.expr("aggregate(n_tokens, 0L, (s, x) -> s + x)").alias("size"))
    offset = prefix_sums(size, [], "group_key", [], {"_o": F.col("size")}, width=GROUP_KEY_BITS).select(
        F.col("group_key").alias("_g"), "_o")
    got = file.mapInArrow(trimmed(read_groups), READ_ROW)
    return got.join(offset, got["group_key"] == offset["_g"]).select(
        "doc_id", (F.col("_o") + F.col("at")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def op7_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers
    out = scratch_path(spark, "token-ids")
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"),
              public_tokenizers.path("word_bpe_49k.json"), out)
    return read_ids(spark, out)
