"""Spelling variants: words one edit apart, found in a frequency-vector trie.

Words are maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` with A-Z lower-cased.  A
word's vector is its length and then how often it has letters of each of
``GROUPS`` letter groups (letters dealt to groups by their frequency in the
vocabulary, so that groups weigh about the same).  The trie arranges words by
these counts, one level for each.  One inserted, deleted or replaced letter
adds at most one to one count and takes at most one from another; a
depth-first search therefore carries a budget of one surplus and one deficit,
and every word in a leaf it reaches is compared letter by letter.  Each pair is
reached once: shorter word to longer, or, at equal length, surplus before
deficit.

How Spark shares the trie: nodes with more than ``part`` words are its top,
counted level by level and broadcast; ``part`` grows with the vocabulary so
that the top never has more than ``TOP_NODES`` nodes.  The search of the top
runs where the words are and sends each word to the parts it can reach, with
what is left of its budget.  A task holds one part (a subtrie of at most
``part`` words), goes on with the search for the words sent to it in bounded
runs, and returns for each word the number and the best of its near words, not
the pairs.  Words that agree in every count can be more than ``part`` only if
they are all rearrangements of each other's groups; such a leaf is dealt to
several tasks by hash.

Counting: tasks add up words in a bounded table before the shuffle.  The
documents that alter a run are known by the crc32 of ``<doc_id>:<run>``, which
is put together from the crc of the prefix and of the run.

Defined results: a null or empty text has no words; a null doc_id is written
as the empty string; repeated rows count each; ties go to the smaller word in
code-point order; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import _BASE, _INV, _TABLE, LOWER, blocks, mix, powers, text_views, trimmed
from ._store import drop, release, saved

MIN_LENGTH, MIN_COUNT, FACTOR, ALTER = 5, 3, 2, 97
GROUPS, LEAF = 16, 8
PART, TOP_NODES = 16384, 1 << 20
TABLE_WORDS, QUERIES, PAIR_BYTES = 150_000, 32768, 4 << 20
LETTERS = 26 + 64
SAME, PLUS, LONGER, DONE, OTHER = range(5)      # state of a search; OTHER: SAME, but at home in another task
_U = np.uint64

_ASCII = np.zeros(256, bool)
_ASCII[65:91] = _ASCII[97:123] = True
_CRC = np.array([zlib.crc32(bytes([b])) for b in range(256)], np.uint32)
_CRC = _CRC ^ _CRC[0]                            # effect of a byte on the state of the crc
_SHORT = 64                                      # bytes of a run whose crc is put together from parts


# ---- words and their counts ---------------------------------------------------

def runs(raw: np.ndarray, off: np.ndarray):
    """Letter runs of a block: starts, ends, first run of each text, 64-bit
    hashes (A-Z lower-cased), code points of each."""
    n = len(raw)
    lead = raw == 0xC3
    solid = _ASCII[raw] | lead
    solid[1:] |= lead[:-1]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:n]
    last[:-1] &= ~solid[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(starts):
        return starts, ends, np.zeros(len(off), np.int64), np.zeros(0, _U), starts
    h = np.add.reduceat(np.where(solid, _TABLE[LOWER[raw]], _U(0)) * powers(_BASE, n), starts)
    h = mix(h * powers(_INV, n)[starts] + (ends - starts).astype(_U))
    pairs = np.concatenate(([0], np.cumsum(lead)))
    return starts, ends, np.searchsorted(starts, off), h, ends - starts - (pairs[ends] - pairs[starts])


def crc_after(prefix: np.ndarray, longest: int) -> np.ndarray:
    """crc32 of each prefix and ``k`` further bytes, up to the crc32 of those
    bytes themselves (exclusive or): row ``k`` for k up to ``longest``."""
    out = np.empty((longest + 1, len(prefix)), np.uint32)
    out[0] = prefix
    for k in range(longest):
        out[k + 1] = (out[k] >> np.uint32(8)) ^ _CRC[out[k] & np.uint32(255)]
    return out


def altered(word: str, h: int) -> str:
    at = h % len(word)
    return word[:at] + word[at + 1:]


def block_counts(ids: list[str], raw: np.ndarray, off: np.ndarray, table: dict, least: int, alter: int) -> None:
    """Add the words of a block of texts to ``table``."""
    starts, ends, first, hashes, points = runs(raw, off)
    if not len(starts):
        return
    low = LOWER[raw].tobytes()
    _, at, word = np.unique(hashes, return_index=True, return_inverse=True)
    doc = np.repeat(np.arange(len(ids)), np.diff(first))
    pair, count = np.unique(doc * len(at) + word, return_counts=True)
    doc, word = np.divmod(pair, len(at))
    names = [low[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]
    crc = np.fromiter(map(zlib.crc32, names), np.uint32, len(names))
    size = (ends - starts)[at]
    prefixes = [f"{i}:".encode() for i in ids]
    after = crc_after(np.fromiter(map(zlib.crc32, prefixes), np.uint32, len(ids)), min(_SHORT, int(size.max())))
    h = after[np.minimum(size[word], len(after) - 1), doc] ^ crc[word]
    for k in np.flatnonzero(size[word] > _SHORT):
        h[k] = zlib.crc32(names[word[k]], zlib.crc32(prefixes[doc[k]]))
    hit = h % alter == 0 if alter else np.zeros(len(h), bool)
    total = np.bincount(word[~hit], count[~hit], len(at)).astype(np.int64)
    for k in np.flatnonzero((total > 0) & (points[at] >= least)).tolist():
        name = names[k]
        table[name] = table.get(name, 0) + int(total[k])
    for k in np.flatnonzero(hit & (points[at][word] > least)).tolist():
        name = altered(names[word[k]].decode(), int(h[k])).encode()
        table[name] = table.get(name, 0) + int(count[k])


def count_words(least: int, alter: int):
    def rows(table: dict):
        words = pa.array(list(table), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(table.values()), pa.int64())], names=["word", "n"])

    def run(batches):
        table: dict = {}
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for i, j, raw, off in blocks(batch.column("text")):
                block_counts(ids[i:j], raw, off, table, least, alter)
                if len(table) > TABLE_WORDS:
                    yield rows(table)
                    table.clear()
        if table:
            yield rows(table)
    return run


def vocabulary(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_length: int = MIN_LENGTH,
               min_count: int = MIN_COUNT, alter: int = 0) -> DataFrame:
    """(word, n): words of at least ``min_length`` code points and ``min_count``
    occurrences.  With ``alter``, a run of a document whose crc32 of
    ``<doc_id>:<run>`` is a multiple of it loses one code point first."""
    rows = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("doc_id"),
                       F.col(f"`{text}`").alias("text"))
    found = rows.mapInArrow(trimmed(count_words(min_length, alter)), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


# ---- vectors and the top of the trie ------------------------------------------

def letters(column) -> tuple[np.ndarray, np.ndarray]:
    """(letter numbers, offsets) of a column of words; numbers follow code points."""
    raw, off = text_views(column)
    lead = raw == 0xC3
    codes = np.where(raw >= 128, 26 + (raw & 63), raw - 97).astype(np.uint8)[~lead]
    return codes, off - np.concatenate(([0], np.cumsum(lead)))[off]


def letter_counts(batches):
    total = np.zeros(LETTERS, np.int64)
    for batch in batches:
        total += np.bincount(letters(batch.column("word"))[0], minlength=LETTERS)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(LETTERS), pa.int32()), pa.array(total)], names=["letter", "n"])


def letter_groups(words: DataFrame, groups: int) -> np.ndarray:
    """Group of each letter: the next most frequent letter joins the lightest group."""
    found = words.select("word").mapInArrow(letter_counts, "letter int, n long").groupBy("letter").agg(F.sum("n").alias("n"))
    load, out = [0] * groups, np.zeros(LETTERS, np.int64)
    for r in sorted(found.collect(), key=lambda r: (-r["n"], r["letter"])):        # one row a letter
        k = load.index(min(load))
        out[r["letter"]] = k
        load[k] += r["n"]
    return out


def vectors(codes: np.ndarray, off: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    size = np.diff(off)
    word = np.repeat(np.arange(len(size)), size)
    counts = np.bincount(word * groups + group[codes], minlength=len(size) * groups).reshape(len(size), groups)
    return np.column_stack([size, counts])


def child(node: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Number of the node that ``count`` leads to."""
    return mix(node * _U(0x9E3779B97F4A7C15) + count.astype(_U) + _U(1))


def among(node: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    if not len(nodes):
        return np.zeros(len(node), bool)
    return nodes[np.minimum(np.searchsorted(nodes, node), len(nodes) - 1)] == node


def node_counts(top: list, group: np.ndarray, groups: int):
    """(node, n): words below each child of the deepest nodes of ``top``."""
    def run(batches):
        for batch in batches:
            v = vectors(*letters(batch.column("word")), group, groups)
            node = np.zeros(len(v), _U)
            for depth, nodes in enumerate(top):
                live = among(node, nodes)
                v, node = v[live], child(node[live], v[live, depth])
            node, n = np.unique(node, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(n.astype(np.int64))], names=["node", "n"])
    return run


def trie_top(words: DataFrame, group: np.ndarray, groups: int, part: int) -> tuple[list, dict]:
    """(sorted nodes with more than ``part`` words of each depth, words of
    such nodes of the last depth)."""
    top = [np.zeros(1, _U)]
    while len(top) <= groups + 1 and len(top[-1]):
        got = (words.select("word").mapInArrow(node_counts(top, group, groups), "node long, n long")
               .groupBy("node").agg(F.sum("n").alias("n")).filter(F.col("n") > part).collect())   # <= words / part
        nodes = np.array([r["node"] for r in got], np.int64).view(_U)
        top.append(np.sort(nodes))
    crowded = {r["node"]: r["n"] for r in got} if len(top) == groups + 2 else {}
    return top[:groups + 1], crowded


# ---- the search ---------------------------------------------------------------

def steps(state: np.ndarray, step: int) -> np.ndarray | None:
    """States that may take a count of ``step`` more than the word's own."""
    if step == 0:
        return np.ones(len(state), bool)
    return (state == SAME) | (state == LONGER) if step == 1 else state == PLUS


def moved(state: np.ndarray, step: int) -> np.ndarray:
    if step == 0:
        return state
    return np.where(state == SAME, PLUS, DONE).astype(np.int8) if step == 1 else np.full(len(state), DONE, np.int8)


def route(shared, groups: int, part: int):
    """(part, depth, state, word, n): each word at home (state SAME), and with
    what is left of its budget in the other parts that it can reach."""
    def run(batches):
        top, crowded, group = shared.value
        last = groups + 1
        for batch in batches:
            v = vectors(*letters(batch.column("word")), group, groups)
            n = len(v)
            which, state = np.tile(np.arange(n), 2), np.repeat([SAME, LONGER], n).astype(np.int8)
            node = child(np.zeros(2 * n, _U), np.concatenate([v[:, 0], v[:, 0] + 1]))
            out = []
            for depth in range(1, last + 1):
                deeper = among(node, top[depth]) if depth < last else np.zeros(len(node), bool)
                out.append((node[~deeper], which[~deeper], state[~deeper], np.full((~deeper).sum(), depth, np.int32)))
                node, which, state = node[deeper], which[deeper], state[deeper]
                if not len(node):
                    break
                found = []
                for step in (0, 1, -1):
                    ok = steps(state, step)
                    count = v[which[ok], depth] + step
                    ok[np.flatnonzero(ok)[count < 0]] = False
                    found.append((child(node[ok], v[which[ok], depth] + step), which[ok], moved(state[ok], step)))
                node, which, state = (np.concatenate(x) for x in zip(*found))
            node, which, state, depth = (np.concatenate(x) for x in zip(*out))
            ok = (depth < last) | (state == SAME) | (state == DONE)
            node, which, state, depth = node[ok], which[ok], state[ok], depth[ok]
            if crowded:
                node, which, state, depth = deal(batch, node, which, state, depth, crowded, last, part)
            picked = batch.take(pa.array(which))
            yield pa.RecordBatch.from_arrays(
                [pa.array(node.view(np.int64)), pa.array(depth), pa.array(state), picked.column("word"), picked.column("n")],
                names=["part", "depth", "state", "word", "n"])
    return run


def deal(batch, node, which, state, depth, crowded: dict, last: int, part: int):
    """Leaves of more than ``part`` words: a word is at home in one of several
    tasks, and searches the later ones or, from elsewhere, all."""
    names = batch.column("word").to_pylist()
    out = []
    for k in range(len(node)):
        tasks = -(-crowded.get(int(node[k].view(np.int64)), 1) // part) if depth[k] == last else 1
        if tasks == 1:
            out.append((node[k], which[k], state[k], depth[k]))
            continue
        own = zlib.crc32(names[which[k]].encode()) % tasks
        for t in range(own if state[k] == SAME else 0, tasks):
            to = mix(np.array([node[k]]) + _U(t + 1))[0]
            out.append((to, which[k], OTHER if state[k] == SAME and t > own else state[k], depth[k]))
    node, which, state, depth = zip(*out)
    return np.array(node, _U), np.array(which), np.array(state, np.int8), np.array(depth, np.int32)


class Subtrie:
    """The words at home in one part, in the order of their vectors."""

    def __init__(self, words: pa.Array, n: np.ndarray, depth: int, group: np.ndarray, groups: int):
        codes, off = letters(words)
        v = vectors(codes, off, group, groups)
        order = np.lexsort(v.T[::-1])
        self.size = int(v[0, 0])
        self.vectors, self.n, self.depth = v[order], n[order], depth
        self.codes = codes.reshape(len(v), self.size)[order]
        self.words = words.take(pa.array(order))
        self.rank = np.empty(len(v), np.int64)
        self.rank[np.lexsort(self.codes.T[::-1])] = np.arange(len(v))
        self.group, self.groups = group, groups

    def search(self, words: pa.Array, n: np.ndarray, state: np.ndarray, own: bool):
        """Near pairs (query, word of the part) of the queries; all of one length."""
        if own:
            codes, v = self.codes, self.vectors
        else:
            raw, off = letters(words)
            codes, v = raw.reshape(len(words), -1), vectors(raw, off, self.group, self.groups)
        room = max(1, PAIR_BYTES // self.size)
        found, held, count = [], [], 0
        stack = [(0, len(self.n), self.depth, np.arange(len(state)), state)]
        while stack:
            lo, hi, depth, q, st = stack.pop()
            if hi - lo <= LEAF or depth > self.groups:
                if depth > self.groups:
                    q, st = (x[(st != PLUS) & (st != LONGER)] for x in (q, st))
                for a in range(0, len(q), max(1, room // (hi - lo))):
                    b = a + max(1, room // (hi - lo))
                    left, right = np.repeat(q[a:b], hi - lo), np.tile(np.arange(lo, hi), len(q[a:b]))
                    if own:
                        ok = (np.repeat(st[a:b], hi - lo) != SAME) | (left < right)
                        left, right = left[ok], right[ok]
                    held.append((left, right))
                    count += len(left)
                    if count >= room:
                        found.append(self.verified(codes, held))
                        held, count = [], 0
                continue
            column = self.vectors[lo:hi, depth]
            cut = np.concatenate(([0], np.flatnonzero(column[1:] != column[:-1]) + 1, [hi - lo]))
            gap = v[q, depth]
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                diff = column[a] - gap
                near = np.abs(diff) <= 1
                cq, cd, cs = q[near], diff[near], st[near]
                ok = (cd == 0) | ((cd == 1) & ((cs == SAME) | (cs == LONGER))) | ((cd == -1) & (cs == PLUS))
                cq, cd, cs = cq[ok], cd[ok], cs[ok]
                if len(cq):
                    cs = np.where(cd == 0, cs, np.where(cs == SAME, PLUS, DONE)).astype(np.int8)
                    stack.append((lo + a, lo + b, depth + 1, cq, cs))
        if held:
            found.append(self.verified(codes, held))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2

    def verified(self, codes: np.ndarray, held: list):
        """Candidate pairs that differ by exactly one letter."""
        left, right = (np.concatenate(x) for x in zip(*held))
        near = np.zeros(len(left), bool)
        room = max(1, PAIR_BYTES // self.size)
        for a in range(0, len(left), room):
            x, y = codes[left[a:a + room]], self.codes[right[a:a + room]]
            if x.shape[1] == self.size:
                near[a:a + room] = (x != y).sum(1) == 1
            else:           # one more letter: a common prefix and a common suffix make up the shorter word
                head = np.logical_and.accumulate(x == y[:, :-1], axis=1).sum(1)
                tail = np.logical_and.accumulate((x == y[:, 1:])[:, ::-1], axis=1).sum(1)
                near[a:a + room] = head + tail >= x.shape[1]
        return left[near], right[near]


def best_rows(words: pa.Array, at: np.ndarray, other: pa.Array, rank: np.ndarray, n: np.ndarray, to: np.ndarray):
    """(word, n_near, best, best_n): for each index in ``at``, the number of its
    near words ``to`` and the one of largest n, the smaller word at ties."""
    if not len(at):
        return None
    order = np.lexsort((rank[to], -n[to], at))
    at, to = at[order], to[order]
    head = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return pa.RecordBatch.from_arrays(
        [words.take(pa.array(at[head])), pa.array(np.diff(np.append(head, len(at))), pa.int64()),
         other.take(pa.array(to[head])), pa.array(n[to[head]], pa.int64())], names=["word", "n_near", "best", "best_n"])


def search_parts(shared, groups: int):
    """Rows in the order of parts and states: first the words at home, then the others."""
    def results(trie, words, n, state, own=False):
        left, right = trie.search(words, n, state, own)
        codes = None if own else letters(words)[0].reshape(len(words), -1)
        rank = trie.rank
        if not own:
            rank = np.empty(len(words), np.int64)
            rank[np.lexsort(codes.T[::-1])] = np.arange(len(words))
        yield from filter(None, (best_rows(words, left, trie.words, trie.rank, trie.n, right),
                                 best_rows(trie.words, right, words, rank, n, left)))

    def ask(trie, rows):
        if trie is None or not rows:
            return
        table = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        words, n, state = table.column("word"), table.column("n").to_numpy(), table.column("state").to_numpy()
        size = np.diff(letters(words)[1])
        state = np.where(state == OTHER, SAME, state).astype(np.int8)
        for k in (trie.size - 1, trie.size):
            pick = np.flatnonzero(size == k)
            if len(pick):
                yield from results(trie, words.take(pa.array(pick)), n[pick], state[pick])

    def home(rows):
        if not rows:
            return None
        table = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        return Subtrie(table.column("word"), table.column("n").to_numpy(), table.column("depth")[0].as_py(),
                       shared.value[2], groups)

    def run(batches):
        part, trie, at_home, rows, held = None, None, [], [], 0
        for batch in batches:
            parts, states = batch.column("part").to_numpy(), batch.column("state").to_numpy()
            cut = np.flatnonzero((parts[1:] != parts[:-1]) | ((states[1:] == SAME) != (states[:-1] == SAME))) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(parts)]):
                if b == a:
                    continue
                if parts[a] != part:
                    yield from finish(trie, at_home, rows)
                    part, trie, at_home, rows, held = parts[a], None, [], [], 0
                piece = batch.slice(a, b - a)
                if states[a] == SAME:
                    at_home.append(piece)
                    continue
                if trie is None and at_home:
                    trie = home(at_home)
                    yield from results(trie, trie.words, trie.n, np.full(len(trie.n), SAME, np.int8), True)
                if trie is not None:                     # no word at home: nothing to find
                    rows.append(piece)
                    held += b - a
                    if held >= QUERIES:
                        yield from ask(trie, rows)
                        rows, held = [], 0
        yield from finish(trie, at_home, rows)

    def finish(trie, at_home, rows):
        if trie is None and at_home:
            trie = home(at_home)
            yield from results(trie, trie.words, trie.n, np.full(len(trie.n), SAME, np.int8), True)
        yield from ask(trie, rows)
    return run


def near_words(words: DataFrame, groups: int = GROUPS, part: int = PART) -> DataFrame:
    """(word, n_near, best, best_n) of the words of (word, n) that have a word
    at one edit: how many, and the one of largest n."""
    total = words.count()
    part = max(part, -(-total * (groups + 2) // TOP_NODES))
    group = letter_groups(words, groups)
    shared = words.sparkSession.sparkContext.broadcast((*trie_top(words, group, groups, part), group))
    sent = words.mapInArrow(route(shared, groups, part), "part long, depth int, state byte, word string, n long")
    found = sent.repartition("part").sortWithinPartitions("part", "state").mapInArrow(
        trimmed(search_parts(shared, groups)), "word string, n_near long, best string, best_n long")
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"),
                                      F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w"))).alias("b"))
            .select("word", "n_near", F.col("b.w").alias("best"), (-F.col("b.m")).alias("best_n")))


def follow(links: DataFrame) -> DataFrame:
    """(word, root): from each word of (word, form) to the end of its chain;
    chains are halved in each round."""
    state = saved(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = saved(state.join(step, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("_moved")), "roots")
        drop(state)
        state = new
        if not state.filter("_moved").count():
            return state.select("word", "root")


def spelling_variants(words: DataFrame, factor: int = FACTOR, groups: int = GROUPS, part: int = PART) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for the distinct words of (word, n)."""
    words = saved(words.select("word", "n"), "words")
    near = saved(near_words(words, groups, part), "near")
    release(words.sparkSession)
    known = words.join(near, "word", "left").withColumn("ok", F.col("best_n") >= factor * F.col("n"))
    known = saved(known.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                               F.when(F.col("ok"), F.col("best")).alias("form"),
                               F.when(F.col("ok"), F.col("best_n")).alias("form_n")), "forms")
    drop(near)
    roots = follow(known.filter("form IS NOT NULL"))
    return known.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return spelling_variants(vocabulary(docs, alter=ALTER))
