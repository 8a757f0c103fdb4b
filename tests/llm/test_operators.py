"""The operators of the subpackage against brute force and on odd input."""

import collections
import hashlib
import math
import random
import re
import tracemalloc
import types
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import _store, chat_views, decontam, jaccard, licenses, mixing, ppm, quality, sharding, suffix_dedup, token_coder
from tessera.llm import queries as Q
from tessera.llm._graph import components
from tessera.operators.prefix import positions, prefix_sums
from tessera.plans.oracle_check import compare, duck

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def raw_words(text):
    return WORD.findall((text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))))


def pairs_of(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_oracle(llm, sf_small, name):
    assert compare(Q.QUERIES[name](llm, sf_small), duck(sf_small), Q.ORACLES[name]) == []


# ---- shared helpers -----------------------------------------------------------

def test_positions_and_prefix_sums(llm):
    df = llm.createDataFrame([(None if i % 11 == 0 else "ab"[i % 7 == 0], i * 5000 % 100_003, i % 5) for i in range(4000)],
                             "g string, o long, v long")
    p = positions(df, ["g"], ["o"], "p", chunks=7).toPandas()
    for _, x in p.groupby("g", dropna=False):
        assert sorted(x.p) == list(range(len(x)))
    s = prefix_sums(df, ["g"], "o", ["v"], {"before": F.col("v")}, width=9).toPandas()
    for _, x in s.groupby("g", dropna=False):
        x = x.sort_values(["o", "v"])
        assert list(x.before) == [0] + list(x.v.cumsum()[:-1])


def test_components(llm):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = dict(pairs_of(components(llm.createDataFrame(edges, "a long, b long")), "node", "label"))
    parent = {}
    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


def test_saved_tables_leave_no_shuffle_files(llm):
    """The files of a phase do not wait for the driver's collector; the session's setting stays as it was."""
    disk = llm.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, old = files(), llm.conf.get(key)
    rows = llm.range(3000).selectExpr("id % 7 AS k").groupBy("k").count()
    joined = rows.join(llm.range(9).withColumnRenamed("id", "k").repartition(3, "k").hint("merge"), "k")
    table = _store.saved(joined, "no-shuffles")
    assert files() <= before and llm.conf.get(key) == old
    assert sorted(pairs_of(table, "k", "count")) == [(k, 429 if k < 4 else 428) for k in range(7)]
    _store.drop(table)


# ---- chat views ---------------------------------------------------------------

def test_chat_views_rotate_and_mask(llm):
    rows = [(1, 0, "system", "be kind"), (1, 1, "Ann B", "hi"), (1, 2, "Cy", "yo"), (1, 3, "Ann B", None), (2, 0, "system", "x")]
    rows += [(3, i, f"p{i % 3}", f"t{i}") for i in range(150)] + [(3, 7, "p1", "t7")] * 2 + [(None, None, None, "n")]
    got = {(r.conv_id, r.perspective, r.part): r for r in
           chat_views.perspectives(llm.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert {k[:2] for k in got} == {(1, "Ann B"), (1, "Cy"), (3, "p0"), (3, "p1"), (3, "p2"), (None, "")}
    r = got[(1, "Ann B", 0)]
    assert r.rendered == ("<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n"
                          "<|im_start|>user name=Cy\nyo<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n")
    assert [r.rendered[a:b] for a, b in zip(r.mask_starts, r.mask_ends)] == ["hi<|im_end|>", "<|im_end|>"]
    assert "user name=Ann_B\n" in got[(1, "Cy", 0)].rendered
    parts = [got[(3, "p0", k)] for k in range(3)]
    assert [p.n_turns for p in parts] == [64, 64, 24]
    assert [p.start for p in parts] == [0, len(parts[0].rendered), len(parts[0].rendered) + len(parts[1].rendered)]
    assert chat_views.perspectives(llm.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# ---- language-model scores ----------------------------------------------------

def brute_trie(texts, order, mass_bits):
    counts = [collections.defaultdict(collections.Counter) for _ in range(order + 1)]
    total = 0
    for t in texts:
        sym = [s for w in raw_words(t) for s in (*w, 32)] + [256]
        for i, s in enumerate(sym):
            ctx = [sym[i - j] if i - j >= 0 else 0 for j in range(1, order + 1)]
            total += 1
            for k in range(order + 1):
                counts[k][tuple(ctx[:k])][s] += 1
    return [{c: n for c, n in level.items() if sum(n.values()) * 2 ** mass_bits >= total} for level in counts]


def brute_prob(trie, ctx, s):
    p, seen = 1.0, set()
    for k in range(len(trie) - 1, -1, -1):
        node = trie[k].get(tuple(ctx[:k]))
        if node is None:
            continue
        left = {x: n for x, n in node.items() if x not in seen}
        total = sum(left.values())
        if s in left:
            return p * (left[s] - 0.5) / total
        if left:
            p *= 0.5 * len(left) / total
        seen |= set(node)
    return p / (257 - len(trie[0].get((), ())))


def test_ppm_against_brute_force(llm):
    rnd = random.Random(5)
    vocab = ["the", "then", "cat", "cats", "ü", "Dog"]
    texts = [" ".join(rnd.choice(vocab) for _ in range(rnd.randrange(0, 30))) for _ in range(40)] + [None, ""]
    rows = [(i, t, i % 4 == 1) for i, t in enumerate(texts)]
    docs = llm.createDataFrame(rows, "doc_id long, text string, held_out boolean").repartition(3)
    got = {r.doc_id: r for r in ppm.score_documents(docs, order=3, mass_bits=8).collect()}
    trie = brute_trie([t for _, t, h in rows if not h], 3, 8)
    train = collections.Counter(w for _, t, h in rows if not h for w in [*raw_words(t), None])
    n, v = sum(train.values()), len(train)
    for i, t, h in rows:
        sym = [s for w in raw_words(t) for s in (*w, 32)] + [256]
        want = sum(math.log10(brute_prob(trie, [sym[j - d] if j >= d else 0 for d in (1, 2, 3)], s)) for j, s in enumerate(sym))
        tokens = [*raw_words(t), None]
        base = sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, len(tokens), sum(train[w] > 0 for w in tokens), n)
        assert math.isclose(r.score, want, rel_tol=1e-9) and math.isclose(r.base_score, base, rel_tol=1e-9)
    for ctx in ([32, 116, 97], [104, 116, 32], [1, 2, 3]):
        assert math.isclose(sum(brute_prob(trie, ctx, s) for s in range(257)), 1.0, rel_tol=1e-9)


def test_ppm_keeps_every_context(llm):
    """A context seen twice is a node however large the corpus is."""
    rows = [(i, "aaaa bbbb " * 60_000, False) for i in range(2)] + [(5, "zqxj vwkp", False), (6, "zqxj vwkp", True)]
    got = {r.doc_id: r.score for r in ppm.score_documents(
        llm.createDataFrame(rows, "doc_id long, text string, held_out boolean").repartition(2)).collect()}
    trie = brute_trie(["aaaa bbbb " * 60_000] * 2 + ["zqxj vwkp"], 5, 60)
    sym = list(b"zqxj vwkp ") + [256]
    want = sum(math.log10(brute_prob(trie, [sym[j - d] if j >= d else 0 for d in range(1, 6)], s)) for j, s in enumerate(sym))
    assert math.isclose(got[5], want, rel_tol=1e-9) and math.isclose(got[6], want, rel_tol=1e-9)


def test_ppm_odd(llm, odd_docs, no_docs):
    held = F.coalesce(F.col("doc_id") == 2, F.lit(False)).alias("held_out")
    got = ppm.score_documents(odd_docs.select("doc_id", "text", held)).collect()
    assert len(got) == odd_docs.count() and all(r.score < 0 and r.n_tokens >= 1 for r in got)
    assert ppm.score_documents(no_docs.select("doc_id", "text", held)).count() == 0
    every = ppm.score_documents(odd_docs.select("doc_id", "text", F.lit(True).alias("held_out"))).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in every)


def test_token_words_are_learnt_by_their_letters_and_signs(monkeypatch):
    """The model sees the letters of a word once, whatever signs follow; the ids are those of the whole tokenizer."""
    import pyarrow as pa
    import public_tokenizers
    from tessera.llm._bytes import blocks
    t = token_coder.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    seen, real = [], t.of_letters
    monkeypatch.setattr(t, "of_letters", lambda part: seen.extend(part) or real(part))
    texts = ["zzqxa, zzqxa zzqxa! Zzqxa; \u00e9zzq. \u00e9zzq,", "zzqxa,### \u00e9zzq### zzqxb. zzqxb? ... ###", None, "",
             "It's a's' 's' x'd. \u00c9'S don't, a\u00d7, \u00f7. a_b_ x1, 1x. , a", "b<|endoftext|>, <|endoftext|>! <|ENDOFTEXT|>,",
             "e\u0301, i\u0307. I\u0307! \u0130. a\u2260 a,\u0338 \u03a3\u03b1\u03c2. \u00df. \u00aa. \u00b5, \u00ff; \x00a, a\x7f. a\x00,"]
    for part in (texts[:1], texts[1:], texts):
        (_, _, raw, off), = blocks(pa.array(part, pa.string()))
        ids, n = t.ids(raw, off, 1)
        want = [t.tokenizer.encode(x or "", add_special_tokens=False).ids + [1] for x in part]
        assert n.tolist() == [len(x) for x in want] and ids.tolist() == sum(want, [])
    assert sorted(x.lower() for x in seen if "zzq" in x.lower()) == ["zzqxa", "zzqxb", "\u00e9zzq"]


def test_token_words_met_again_are_neither_searched_nor_learnt(monkeypatch):
    """A-Z and a-z are one for words with letters of Latin-1 too; a word known for long is found at its place."""
    import pyarrow as pa
    import public_tokenizers
    from tessera.llm._bytes import blocks
    t = token_coder.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    seen, real = [], t.of_letters
    monkeypatch.setattr(t, "of_letters", lambda part: seen.extend(part) or real(part))
    odd = ["\u00e9zzqx \u00e9ZZQX, \u00e9Zzqx", "T\u0308 t\u0308 \u1e97 \u00c0 \u00ad", "<|endoftext|> <|ENDOFTEXT|>", None,
           *("x" * n + " " + "X" * n + "y " + "x" * n + "\x00" for n in (7, 8, 9, 16, 63, 64, 65, 700))]
    (_, _, raw, off), = blocks(pa.array(odd, pa.string()))
    want = [t.tokenizer.encode(x or "", add_special_tokens=False).ids + [1] for x in odd]
    for k in range(3):
        if k == 2:
            monkeypatch.setattr(t, "row_of", lambda h: pytest.fail(f"{len(h)} words searched"))
        ids, n = t.ids(raw, off, 1)
        assert n.tolist() == [len(x) for x in want] and ids.tolist() == sum(want, [])
    assert sum("zzqx" in x.lower() for x in seen) == 1


def test_ppm_strings_in_a_blocks_own_alphabet():
    """Sorted by rank and position as one number, a block's strings are those of all 256 bytes, in their order."""
    for texts in (["", "The cat\t and THE hat", "\u00fcber 1\u2026", "a" * 300], ["".join(map(chr, range(1, 700))) * 3]):
        raw = np.frombuffer("".join(texts).encode(), np.uint8)
        off = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
        sym, begin = ppm.symbols(raw, off, *ppm.words(raw, off))
        naive = []
        for t in texts:
            low = bytes(b + 32 if 65 <= b <= 90 else b for b in t.encode())
            one = [x for w in re.findall(rb"[^\x20\x09-\x0D]+", low) for x in w + b" "] + [256]
            naive += [sum((one[i - j] if i >= j else 0) << 9 + 8 * (5 - j) for j in range(1, 6)) | x for i, x in enumerate(one)]
        keys, abc = ppm.strings(sym, begin, 5), ppm.Alphabet(raw)
        assert keys.tolist() == naive
        ranks = ppm.strings(abc.rank[sym], begin, 5, abc.bits, abc.bits)
        assert abc.strings(ranks, 5).tolist() == naive
        for bits in (6 * abc.bits, 62):                      # 62: runs of four
            got, place, new = ppm.ranked(ranks, bits)
            run = min(len(keys), 1 << 64 - bits)
            each = np.empty(len(keys), np.uint64)
            each[place] = np.repeat(got, np.diff(np.append(np.flatnonzero(new), len(new))))
            assert (each == ranks).all()
            assert len(got) == sum(len(set(naive[i:i + run])) for i in range(0, len(naive), run))


def test_ppm_texts_go_to_python_in_bounded_batches(llm, monkeypatch):
    limits, saved = [], ppm.saved
    monkeypatch.setattr(ppm, "saved", lambda df, name: limits.append(llm.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) or saved(df, name))
    docs = llm.createDataFrame([(1, "a b", False), (2, "b c", True)], "doc_id long, text string, held_out boolean")
    assert ppm.score_documents(docs).count() == 2
    assert set(limits) == {str(ppm.BATCH_BYTES)}


def test_ppm_memory_of_a_bucket_is_that_of_its_distinct_strings(monkeypatch):
    raw, off = np.frombuffer(b"the others there " * 40 + b"their theme thins the ether", np.uint8), np.array([0, 707])
    sym, begin = ppm.symbols(raw, off, *ppm.words(raw, off))
    keys, n = ppm.counted(np.concatenate([ppm.strings(sym, begin, 5), np.arange(4000, dtype=np.uint64) << np.uint64(9) | np.uint64(7)]))
    n[::3] = 0                                               # only in texts held out
    low, every, blocks = ppm.Trie(5), ppm.Trie(5), 300
    some = n > 0
    for trie, top in ((low, ppm.LOW), (every, 5)):
        for k in range(top + 1):
            trie.add(*ppm.level(keys[some], n[some] * blocks, 5, k))

    def batches(some):
        for block in range(some):
            yield pa.RecordBatch.from_arrays(
                [pa.array([3], pa.int32()), pa.array([block], pa.int64()), pa.array([keys.tobytes()], pa.binary()),
                 pa.array([n.astype(np.int32).tobytes()], pa.binary())], names=["bucket", "block", "keys", "n"])

    monkeypatch.setattr(ppm, "SPOOL_BYTES", 1 << 16, raising=False)
    monkeypatch.setattr(ppm, "MERGE_KEYS", 1 << 12)
    want, seen, run = every.log10(keys), [], ppm.score_strings(5, types.SimpleNamespace(value=low), 0)
    assert sum(x.num_rows for x in run(batches(2))) == 2     # imports what is needed
    tracemalloc.start()
    for got in run(batches(blocks)):
        assert got.nbytes < 4 << 20
        for row in got.to_pylist():
            assert row["bucket"] == 3 and np.array_equal(np.frombuffer(row["logs"], np.float64), want)
            seen.append(row["block"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == list(range(blocks))
    assert peak < 8 * len(keys) * blocks                     # less than the strings themselves


def test_ppm_texts_meet_results_in_small_rows(llm, monkeypatch):
    plans, saved = [], ppm.saved
    monkeypatch.setattr(ppm, "saved", lambda df, name: (name == "scores" and plans.append(df._jdf.queryExecution().executedPlan().toString())) or saved(df, name))
    docs = llm.createDataFrame([(i if i % 7 else None, "a b " * (i % 9) + "c", i % 3 == 0) for i in range(40)], "doc_id long, text string, held_out boolean")
    got = ppm.score_documents(docs).select("doc_id", "held_out", "n_tokens").collect()
    assert plans and not any(x in p for p in plans for x in ("Join", "collect_list"))    # each makes a row of a whole block
    assert sorted(map(str, got)) == sorted(map(str, docs.selectExpr("doc_id", "held_out", "size(split(text, ' ')) + 1L as n_tokens").collect()))
    cut = [x for b in ppm.pack_blocks("text", 2)([pa.RecordBatch.from_pylist(
        [{"doc_id": i, "text": "words " * 20_000, "held_out": False} for i in range(9)])]) for x in ppm.cut_blocks([b])]
    assert len(cut) > 2 and all(len(x["body"][0].as_py()) <= ppm.BLOCK for x in cut)
    assert [i for x in cut for i in x["doc_id"][0].as_py()] == list(range(9))


def test_saved_pages_end_by_size(llm):
    rows = llm.range(0, 6, 1, 1).select(F.expr("repeat(sha2(cast(id as string), 512), 12000)").alias("body"))
    out = _store.saved(rows, "pages")
    jvm, path = llm.sparkContext._jvm, out.inputFiles()[0]
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(
        jvm.org.apache.hadoop.fs.Path(path), llm._jsc.hadoopConfiguration()))
    pages = reader.readOffsetIndex(reader.getFooter().getBlocks().get(0).getColumns().get(0)).getPageCount()
    reader.close()
    assert pages > 1 and out.count() == 6
    _store.drop(out)


def test_ppm_passes_give_the_same_rows(llm, monkeypatch):
    """Each pass deals only its own blocks; together they score every text once."""
    docs = llm.createDataFrame([(i, f"some text {i} {i % 7}", i % 5 == 1) for i in range(60)],
                               "doc_id long, text string, held_out boolean").repartition(12)
    sizes, saved = [], ppm.saved

    def counted(df, name):
        out = saved(df, name)
        if name == "scores":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(ppm, "saved", counted)
    got = sorted(tuple(r) for r in ppm.score_documents(docs).collect())
    assert len(sizes) == ppm.PASSES > 1 and sum(sizes) == len(got) == 60
    monkeypatch.setattr(ppm, "PASSES", 1)
    want = sorted(tuple(r) for r in ppm.score_documents(docs).collect())
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert all(math.isclose(x, y, rel_tol=1e-9) for a, b in zip(got, want) for x, y in zip(a[5:], b[5:]))


# ---- mixing -------------------------------------------------------------------

def deviation(blocks, share, slots):
    """Largest distance of any source from its share of blocks, over ``slots`` slots."""
    t = np.arange(1, slots + 1)
    return max(np.abs(np.searchsorted(np.sort(blocks[s]), t, "left") - float(w) * t).max() for s, w in share.items())


@pytest.mark.parametrize("weights", [
    {"a": 9, "b": 1}, {"a": 99, "b": 1}, {"a": 5, "b": 3, "c": 1, "d": 1}, {"a": 1 / 3, "b": 1 / 3, "c": 1 / 3},
    {"a": 0.7, "b": 0.2, "c": 0.1}, {"a": 1 / 7, "b": 2 / 3}, {"a": 2 ** 0.5, "b": math.pi},
    {f"s{k}": k % 37 + 1 for k in range(1000)}, {f"s{k}": 1 / (k + 1) for k in range(1000)}])
def test_schedule_keeps_the_given_weights(weights):
    """Against the given weights, not those of the code under test."""
    parts = mixing.parts_of(weights)
    d, slots = sum(parts.values()), 10_000
    cycle = mixing.schedule(list(parts.values()))
    assert sorted(t for x in cycle for t in x) == list(range(d))
    total = sum(Fraction(w) for w in weights.values())
    share = {s: Fraction(w) / total for s, w in weights.items()}
    blocks = {s: np.concatenate([np.array(x) + k * d for k in range(-(-slots // d))]) for s, x in zip(parts, cycle)}
    # weights without a common unit of 1/MAX_PARTS are rounded to it, as documented
    rounded = slots / (2 * mixing.MAX_PARTS) if any(Fraction(parts[s], d) != share[s] for s in parts) else 0
    assert deviation(blocks, share, slots) < 1 + rounded
    assert rounded == 0 or d == mixing.MAX_PARTS or max(abs(Fraction(parts[s], d) - share[s]) for s in parts) < 1e-15
    for s, x in zip(parts, cycle):
        assert all(j * d // parts[s] <= t < -(-(j + 1) * d // parts[s]) for j, t in enumerate(x))


def test_parts_are_exact():
    assert mixing.parts_of({"a": 9, "b": 1, "c": 0}) == {"a": 9, "b": 1}
    assert mixing.parts_of({"a": 1 / 3, "b": 2 / 3}) == {"a": 1, "b": 2} and mixing.parts_of({"a": 0.25, "b": 0.5}) == {"a": 1, "b": 2}
    odd = mixing.parts_of({"a": math.pi, "b": 1e-12, "c": 2 ** 0.5})
    assert sum(odd.values()) == mixing.MAX_PARTS and odd["b"] == 1
    with pytest.raises(ValueError):
        mixing.parts_of({"a": 1, "b": -1})


def test_mixing_rows_follow_the_schedule(llm):
    rows = [(i, "abcd"[min(3, i % 9)]) for i in range(9000)]
    docs = llm.createDataFrame(rows, "doc_id long, source string")
    weights = {"a": 5, "b": 3, "c": 1, "d": 1}
    got = mixing.mix_sources(docs, weights, block_rows=10).toPandas()
    assert len(got) == 9000 and (got.release <= got.slot).all() and (got.slot < got.deadline).all()
    b = got.groupby(["source", "block"]).slot.agg(["first", "nunique", "size"]).reset_index()
    assert (b["nunique"] == 1).all() and b["first"].is_unique and got.in_block.between(0, 9).all()
    end = int(b.groupby("source")["first"].max().min())
    blocks = {s: x["first"].to_numpy() for s, x in b.groupby("source")}
    assert deviation(blocks, {s: Fraction(w, 10) for s, w in weights.items()}, end) < 1
    unnamed = mixing.mix_sources(docs, {"a": 1, "c": 1}).toPandas()
    assert unnamed[unnamed.source.isin(["b", "d"])][["slot", "release", "deadline"]].isna().all().all() and len(unnamed) == 9000


def test_mixing_odd(llm, odd_docs, no_docs):
    clash = odd_docs.withColumns({c: F.lit(c) for c in ("d", "w", "slots", "_pos", "_part", "_h", "_w", "_name", "_row", "slot", "x")})
    got = mixing.mix_sources(clash)
    assert got.columns == [c for c in clash.columns if c not in mixing.ADDED] + mixing.ADDED
    keep = [c for c in clash.columns if c not in mixing.ADDED]
    assert got.select(keep).exceptAll(clash.select(keep)).count() == 0 and got.count() == odd_docs.count()
    assert mixing.mix_sources(no_docs).count() == 0 and mixing.mix_sources(no_docs, {"a": 1}).count() == 0
    ordered = mixing.in_mix_order(odd_docs)
    assert ordered.columns == odd_docs.columns and ordered.exceptAll(odd_docs).count() == 0
    many = llm.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 700).alias("source"))
    mixed = mixing.mix_sources(many, block_rows=4)
    assert mixed.count() == 2000 and mixed.filter("slot IS NULL").count() == 0
    assert mixing.mix_sources(odd_docs, {"a": 3, "b": 1}).count() == odd_docs.count()
    assert mixing.in_mix_order(odd_docs, weights={"b": 1}).first().source == "b"


# ---- repeated passages --------------------------------------------------------

def brute_repeats(docs, window):
    seen, out = set(), {}
    for i, t in sorted(docs):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - window + 1):
            x = b[s:s + window]
            if x in seen:
                gone[s:s + window] = True
            seen.add(x)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[i] = (len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()),
                  hashlib.sha256(kept).hexdigest())
    return out


def test_two_stage_sort():
    rnd = random.Random(1)
    for _ in range(150):
        window, letters = rnd.choice([3, 8, 9, 16]), rnd.choice(["ab", "a", "abcdefgh"])
        strs = ["".join(rnd.choice(letters) for _ in range(rnd.randint(window, window + 20))).encode()
                for _ in range(rnd.randint(1, 8))]
        begin = np.concatenate(([0], np.cumsum([len(s) for s in strs])))
        x = np.frombuffer(b"".join(strs), np.uint8)
        sa, lcp = suffix_dedup.sort_suffixes(x, begin, window)
        got = [bytes(x[p:p + window]) for p in sa]
        assert got == sorted(s[p:p + window] for s in strs for p in range(len(s) - window + 1))
        for j in range(1, len(got)):
            same = next((k for k in range(window) if got[j][k] != got[j - 1][k]), window)
            assert same == lcp[j]


def test_repeats_against_brute_force(llm):
    rnd = random.Random(2)
    base = ["".join(rnd.choice("abcd ") for _ in range(400)) for _ in range(6)]
    rows = []
    for i in range(140):
        k = rnd.random()
        if k < .2:
            t = rnd.choice(base)
        elif k < .6:
            b, a = rnd.choice(base), rnd.randint(0, 200)
            t = "".join(rnd.choice("abé") for _ in range(rnd.randint(0, 50))) + b[a:a + rnd.randint(50, 300)] + rnd.choice(base)[50:]
        elif k < .8:
            t = "a" * rnd.randint(0, 700)
        else:
            t = rnd.choice(["abc" * rnd.randint(0, 200), "", "short", None])
        rows.append((i, t))
    docs = llm.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r[0]: tuple(r)[1:5] for r in suffix_dedup.remove_repeats(docs, chunk_bytes=2000).collect()}
    assert got == brute_repeats([(i, t or "") for i, t in rows], 100)


def test_repeats_odd(llm, odd_docs, no_docs):
    got = suffix_dedup.remove_repeats(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[3].n_bytes == by[4].n_bytes == 0 and by[7].n_removed == by[8].n_removed == 0
    assert by[-5].n_removed == 500 - 1 and by[2].n_removed >= 300
    late = [r for r in got if r.doc_id is None and r.n_bytes]
    assert late[0].n_removed == late[0].n_bytes                         # a null id comes last
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


def test_repeats_far_apart_in_one_text(llm):
    rnd = random.Random(4)
    part = lambda n: "".join(rnd.choices("abcdefghijklmnop ", k=n))
    passage, far = part(300), 2 * suffix_dedup.PIECE
    text = part(1000) + passage + part(far) + passage + part(far) + passage[:150]
    got = {r[0]: tuple(r)[1:5] for r in suffix_dedup.remove_repeats(
        llm.createDataFrame([(1, text), (2, part(500))], "doc_id long, text string")).collect()}
    assert got[1] == brute_repeats([(1, text)], 100)[1] and got[1][1] >= 450 and got[2][1] == 0


def test_repeats_keep_the_first_of_repeated_rows(llm):
    rnd = random.Random(6)
    part = lambda n: "".join(rnd.choices("abcdefghijklmnop ", k=n))
    passage = part(300)
    rows = [(1, part(200) + passage + part(200))] * 3 + [(2, part(150) + passage + part(90))] * 2 + [(3, passage + part(30))]
    got = suffix_dedup.remove_repeats(llm.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    want = brute_repeats(sorted(set(rows)), 100)
    assert len(got) == len(rows) and all(tuple(r)[1:5] == want[r[0]] for r in got) and want[1][1] == 0


# ---- sharding -----------------------------------------------------------------

def test_quotas_keep_counts():
    rnd = np.random.default_rng(1)
    for _ in range(50):
        wish, free = rnd.integers(0, 30, (6, 6)), rnd.integers(0, 20, 6)
        np.fill_diagonal(wish, 0)
        take, fill = sharding.quotas(wish, free)
        net = take.sum(0) - take.sum(1)
        used = np.zeros(6, int)
        for i, j, k in fill:
            net[i] -= k
            net[j] += k
            used[i] += k
        assert (net == 0).all() and (take <= wish).all() and (take >= 0).all() and (used <= free).all()


def test_sharding_law_and_groups(llm, odd_docs, no_docs):
    rows = [(i, f"text {i // 3}" if i < 300 else f"one {i}") for i in range(1500)] + [(9000 + i, "hot copy") for i in range(700)]
    got = sharding.shard_documents(llm.createDataFrame(rows, "doc_id long, text string"), 10).toPandas()
    n = got.groupby("shard").size()
    assert n.max() - n.min() <= 1 and len(n) == 10
    assert all(sorted(x.slot) == list(range(len(x))) for _, x in got.groupby("shard"))
    text = dict(rows)
    assert all(r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.size == len(text[r.doc_id]) + 16 for r in got.itertuples())
    small = got[got.doc_id < 300].groupby(got.doc_id // 3).shard.nunique()
    assert (small == 1).all()
    odd = sharding.shard_documents(odd_docs, 4).toPandas()
    assert len(odd) == odd_docs.count() and odd.groupby("shard").size().max() - odd.groupby("shard").size().min() <= 1
    assert sharding.shard_documents(no_docs).count() == 0


# ---- benchmark passages -------------------------------------------------------

def test_leaks_odd_and_in_blocks(llm, odd_docs, no_docs):
    bench = llm.createDataFrame([(1, "the quick brown fox JUMPS over the lazy dog and then"), (2, "short, text"), (3, None),
                                 (4, " ... "), (None, "line line"), (2, "short, text"),
                                 (5, "runs to the river in the town with a friend of the house")], "item_id long, text string")
    one = decontam.find_leaks(odd_docs, bench)
    assert set(odd_docs.columns) <= set(one.columns) and one.count() == odd_docs.count()
    cols = ["doc_id", "text", "n_words", "n_hit", "hit_spans", "item_ids"]
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(pairs_of(one, *cols), key=key) == sorted(
        pairs_of(decontam.find_leaks(odd_docs, bench, block_words=5), *cols), key=key)
    by = {r.doc_id: r for r in one.collect()}
    assert by[7].item_ids == ["2"] and by[7].n_hit == 2 and by[3].n_words == 0 and by[9].item_ids == [""]
    assert by[2].item_ids == ["1", "5"]
    b = by[2].text.encode()
    assert b[by[2].hit_spans[0].start:by[2].hit_spans[0].end].startswith(b"The quick brown fox")
    assert decontam.find_leaks(no_docs, bench).count() == 0
    none = llm.createDataFrame([], "item_id long, text string")
    assert decontam.find_leaks(odd_docs, none).filter("n_hit > 0").count() == 0
    assert decontam.drop_leaks(odd_docs, bench).columns == odd_docs.columns


# ---- token files --------------------------------------------------------------

def coded_bits(ids):
    header, coded = token_coder.encode(ids)
    assert (token_coder.decode(header, coded) == ids).all()
    return 8 * (len(header) + sum(map(len, coded)))


def test_coder_round_trip():
    rnd = np.random.default_rng(0)
    size = token_coder.BLOCK_IDS
    for n, k in ((1, 1), (5, 3), (600, 2), (3000, 40000), (20000, 300), (5000, 1), (size, 9), (size + 1, 9), (3 * size, 50), (70_000, 60_000)):
        ids = rnd.integers(0, k, n) * 7 % 49408
        header, coded = token_coder.encode(ids)
        assert (token_coder.decode(header, coded) == ids).all() and len(coded) == -(-n // size)
        assert all((token_coder.decode(header, [b]) == ids[i * size:(i + 1) * size]).all()
                   for i, b in enumerate(coded[:3]))                    # blocks stand alone
        assert (token_coder.decode(header, coded[-1:]) == ids[(len(coded) - 1) * size:]).all()
    big = rnd.integers(0, 1 << 31, 9000)
    assert coded_bits(big) and coded_bits(np.arange(100_000))
    text = np.tile(np.arange(50), 400)
    assert coded_bits(text) < len(text)
    header, coded = token_coder.encode(text)
    broken = bytearray(coded[0])
    broken[-1] ^= 1
    with pytest.raises(ValueError):
        token_coder.decode(header, [bytes(broken)])
    assert token_coder.encode(np.zeros(0, np.int64)) == (b"", []) and len(token_coder.decode(b"", [])) == 0


def test_predictions_of_known_ids_are_those_of_the_steps():
    """A writer gets the predictions of all steps in one call; a reader gets the same ones step by step."""
    rnd = np.random.default_rng(5)
    for steps, lanes, kinds in ((1, 1, 1), (31, 2, 3), (700, 130, 4), (500, 3, 60_000)):
        x = (rnd.integers(0, kinds, (steps, lanes)) * rnd.integers(0, 2, (steps, lanes))).astype(np.int32)
        a = np.concatenate([np.full((1, lanes), kinds, np.int32), x[:-1]])
        b = np.concatenate([np.full((1, lanes), kinds, np.int32), a[:-1]])
        said, share = (v.reshape(steps, lanes) for v in token_coder.Recent(lanes, x).predict(a.ravel(), b.ravel()))
        reader, used = token_coder.Recent(lanes), 0
        for t in range(steps):
            one, part = reader.predict(a[t], b[t])
            assert (part == share[t]).all() and (one == said[t])[part > 0].all()
            used += (part > 0).sum()
            reader.learn(x[t])
        assert used or steps < 700


def test_every_order_pays(monkeypatch, llm):
    """Below the entropy of single ids, and each order saves something."""
    import public_tokenizers
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [r.text or "" for r in llm.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(400).collect()]
    ids = np.concatenate([e.ids + [1] for e in tok.encode_batch(texts, add_special_tokens=False)])[:300_000]
    share = np.bincount(ids)[np.unique(ids)] / len(ids)
    full = coded_bits(ids)
    assert full < 0.9 * len(ids) * -(share * np.log2(share)).sum()
    real = token_coder.Recent.predict
    monkeypatch.setattr(token_coder.Recent, "predict", lambda self, a, b: (real(self, a, b)[0], np.zeros(len(a), np.int32)))
    without_2 = coded_bits(ids)
    monkeypatch.setattr(token_coder, "LEAST_PAIR", 1 << 40)
    assert full < without_2 < coded_bits(ids)


def test_special_tokens_and_repeated_rows(llm, tmp_path):
    """Words are known by their bytes as they are, in any order of texts; equal rows that fill a group each stay apart."""
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    mixed = ["<|endoftext|> <|ENDOFTEXT|>", "<|ENDOFTEXT|> <|endoftext|>", "The THE the", "x<|endoftext|>y X<|EndOfText|>Y"]
    big = " ".join(f"w{k}" for k in range(3000))
    for order in (mixed, mixed[::-1]):
        rows = [*enumerate(order), (50, big), (50, big), (50, big), (60, "short"), (60, "short")]
        out = str(tmp_path / f"s{order is mixed}")
        token_coder.write_ids(llm.createDataFrame(rows, "doc_id long, text string").coalesce(1), path, out, group_ids=1000)
        got = sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in token_coder.read_ids(llm, out).collect())
        want = []
        for i, t in rows:
            ids = np.array(tok.encode(t, add_special_tokens=False).ids + [1], "<u4")
            want.append((i, len(ids), zlib.crc32(ids.tobytes())))
        assert got == sorted(want)
        starts = sorted((r.start, r.n_tokens) for r in token_coder.read_ids(llm, out).collect())
        assert [s for s, _ in starts] == list(np.cumsum([0] + [n for _, n in starts])[:-1])


def test_token_files(llm, odd_docs, no_docs, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    token_coder.write_ids(odd_docs, path, str(tmp_path / "a"), group_ids=500)
    got = sorted(token_coder.read_ids(llm, str(tmp_path / "a")).collect(), key=lambda r: r.start)
    tok, at = Tokenizer.from_file(path), 0
    texts = collections.defaultdict(list)
    for i, t in pairs_of(odd_docs, "doc_id", "text"):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        texts[i].append((len(ids), zlib.crc32(ids.tobytes())))
    for r in got:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in texts[r.doc_id]
        texts[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        at += r.n_tokens
    assert not any(texts.values())
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda x: (x is not None, x or 0))
    token_coder.write_ids(no_docs, path, str(tmp_path / "b"))
    assert token_coder.read_ids(llm, str(tmp_path / "b")).count() == 0


# ---- near duplicates ----------------------------------------------------------

def brute_links(docs, width=5, percent=80):
    sets = {}
    for k, (_, t) in enumerate(docs):
        w = raw_words(t)
        sets[k] = {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    label = list(range(len(docs)))
    def find(x):
        while label[x] != x:
            x = label[x]
        return x
    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    ids = collections.defaultdict(list)
    for k, (i, _) in enumerate(docs):
        ids[find(k)].append(i)
    first = {k: min((i for i in v if i is not None), default=None) for k, v in ids.items()}
    return sorted(((i, len(sets[k]), first[find(k)]) for k, (i, _) in enumerate(docs)), key=str)


def test_near_duplicates_against_brute_force(llm):
    rnd = random.Random(4)
    word = lambda: rnd.choice("abcdefgh") + rnd.choice("xyz")
    passage = [word() for _ in range(25)]
    docs = []
    for g in range(14):
        base = [word() for _ in range(rnd.randrange(1, 120))]
        for _ in range(rnd.choice([1, 2, 5, 30])):
            w = list(base)
            for _ in range(rnd.randrange(0, 1 + len(w) // 40)):
                w[rnd.randrange(len(w))] = word().upper()
            if rnd.random() < .2:
                w += passage
            docs.append((len(docs), rnd.choice([" ", "\n", "\t "]).join(w)))
    df = llm.createDataFrame(docs, "doc_id long, text string").repartition(4)
    for how in ({}, {"hot_df": 2, "block_nodes": 7}):
        got = pairs_of(jaccard.near_duplicates(df, sketch_bits=12, **how), "doc_id", "n_shingles", "component_id")
        assert sorted(got, key=str) == brute_links(docs)


def test_near_duplicates_odd(llm, odd_docs, no_docs):
    docs = pairs_of(odd_docs, "doc_id", "text")
    got = sorted(pairs_of(jaccard.near_duplicates(odd_docs), "doc_id", "n_shingles", "component_id"), key=str)
    want = brute_links(docs)
    assert [(a, n, c if n else a) for a, n, c in want] == got
    kept = jaccard.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted([1, 3, 4, 5, 6, None, 7, 9, 10, -5, 12], key=str)
    assert jaccard.near_duplicates(no_docs).count() == 0 and jaccard.keep_one(no_docs).count() == 0


# ---- quality and licences -----------------------------------------------------

def test_quality_odd(llm, odd_docs, no_docs):
    got = quality.apply_rules(odd_docs).collect()
    by = {r.doc_id: r for r in got}
    assert by[3].n_words == 0 and by[3].base_failed and not by[3].kept and by[1].kept
    assert by[10].n_repeat_words == 300 and "too_repetitive" in by[10].failed_rules
    assert by[9].n_dup_lines == 1 and by[12].n_words == 3
    assert quality.keep_clean(odd_docs).columns == odd_docs.columns
    assert quality.apply_rules(no_docs).count() == 0


def test_quality_plan_is_native(llm, odd_docs):
    plan = quality.apply_rules(odd_docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_licenses_inherit_from_the_nearest_directory(llm):
    mit, apache = "<p>Released under the MIT License.</p>", "// Licensed under the Apache License, Version 2.0"
    rows = [(1, "http://h/a/LICENSE", mit), (2, "http://h/a/b/x.py", "code"), (3, "http://h/a/b/c/y.py", "code"),
            (4, "http://h/a/b/COPYING.txt", apache), (5, "http://h/z.py", "code"), (6, "http://h/a/own.py", apache + "\ncode"),
            (7, None, mit), (8, "http://h/a/k", None), (9, "", ""), (None, "http://h/a/q", "x"), (6, "http://h/a/own.py", apache)]
    got = {(r.id, r.dir): r for r in licenses.scan_licences(
        llm.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    take = lambda i, d: (got[i, d].license, got[i, d].from_dir)
    assert take(2, "h/a/b/") == ("Apache-2.0", "h/a/b/") == take(3, "h/a/b/c/")
    assert take(8, "h/a/") == ("MIT", "h/a/") == take(None, "h/a/") and take(5, "h/") == (None, None)
    assert take(6, "h/a/") == ("Apache-2.0", None) and take(9, "") == ("MIT", "")
    assert licenses.scan_licences(llm.createDataFrame([], "page_id long, url string, html string")).count() == 0


def cosine_by_hand(text, template):
    words = lambda t: collections.Counter(re.findall("[a-z0-9]+", t.lower()))
    all_ = [words(t) for _, t in licenses.TEMPLATES]
    idf = lambda w: (math.log((1 + len(all_)) / (1 + sum(w in c for c in all_))) + 1) * (0.25 if w in licenses.COMMON else 1)
    weigh = lambda c: {w: (1 + math.log(n)) * idf(w) for w, n in c.items()}
    a, b = weigh(words(text)), weigh(words(template))
    return sum(x * b.get(w, 0) for w, x in a.items()) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))


def test_licenses_whole_files_headers_and_copies(llm):
    """The same notices with one copy and with many; notices over several lines; whole licence files."""
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT" and "NONINFRINGEMENT" in t)
    bsd = next(t for n, t in licenses.TEMPLATES if n == "BSD-3-Clause" and "DAMAGE" in t)
    wrap = lambda t, n: "\n".join(" ".join(t.split()[i:i + n]) for i in range(0, len(t.split()), n))
    apache = "# Copyright someone\n# Licensed under the Apache License,\n# Version 2.0 (the License); you may not\n# use this file except in compliance\n# with the License."
    texts = ["x = 1\n\n" + apache + "\n\nimport y", "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + wrap(mit, 11), wrap(bsd, 9),
             "code\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software\ncode",
             "MIT License", "some text of the law and the public without any notice in it", None]
    names = ["a.py", "LICENSE", "COPYING", "b.c", "README", "c.txt", "d"]
    seen = []
    for copies in (1, 500):
        rows = [(i * copies + k, f"http://h{i}/{k}/{n}", t) for i, (n, t) in enumerate(zip(names, texts)) for k in range(copies)]
        got = licenses.scan_licences(llm.createDataFrame(rows, "page_id long, url string, html string")).collect()
        seen.append({r.id // copies: (r.own_license, r.own_score) for r in got})
        assert len(got) == len(rows)
    assert seen[0] == seen[1]
    assert [seen[0][i][0] for i in range(7)] == ["Apache-2.0", "MIT", "BSD-3-Clause", "MIT", "MIT", None, None]
    for i, unit in ((2, texts[2]), (3, texts[3].split("\n")[1]), (4, "MIT License")):
        assert seen[0][i][1] == round(max(cosine_by_hand(unit, t) for _, t in licenses.TEMPLATES), 6)


def test_gate_loses_no_licence():
    """Whatever is left out shares no telling term and is below the threshold."""
    rnd = random.Random(3)
    words = sorted({w for _, t in licenses.TEMPLATES for w in re.findall("[a-z0-9]+", t.lower())})
    gate = re.compile(licenses.gate(licenses.MIN_COSINE))
    silent = [w for w in words if not gate.search(w)]
    assert len(silent) > 30
    for _, t in licenses.TEMPLATES:
        kept = " ".join(w for w in re.findall("[a-z0-9]+", t.lower()) if not gate.search(w))
        for text in (kept, " ".join(rnd.choices(silent, k=9)), kept + " " + " ".join(rnd.choices(silent, k=3))):
            if text.strip():
                assert max(cosine_by_hand(text, u) for _, u in licenses.TEMPLATES) < licenses.MIN_COSINE


def test_licenses_clashing_columns(llm):
    rows = [(1, "http://h/LICENSE", "MIT License", "u", "v", 1), (2, "http://h/x", None, None, None, None)]
    got = licenses.scan_licences(llm.createDataFrame(rows, "page_id long, url string, html string, unit string, file string, name int"))
    assert {(r.id, r.license) for r in got.collect()} == {(1, "MIT"), (2, "MIT")}
