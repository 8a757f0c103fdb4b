"""Lexical search, spelling variants and line dedup against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import lexical, lines, variants

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- lines --------------------------------------------------------------------

def plain_lines(texts, min_docs=10, min_chars=1):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    split = [(t or "").split("\n") for t in texts]
    seen = collections.Counter(k for ls in split for k in {key(x) for x in ls})
    out = []
    for ls in split:
        kept = [x for x in ls if len(key(x)) < min_chars or seen[key(x)] < min_docs]
        out.append((len(ls), len(ls) - len(kept), "\n".join(kept)))
    return out


def line_rows():
    rnd = random.Random(5)
    pool = [f"Line {i} of the Pool" for i in range(30)] + ["", "  ", "\t", "É Line", "é line", "É LINE ", " x", "a\u0000b"]
    out = []
    for i in range(120):
        ls = [rnd.choice(pool) if rnd.random() < .6 else f"own {i} {j}" for j in range(rnd.randrange(8))]
        ls = [x.upper() if rnd.random() < .2 and x.isascii() else x + " " * rnd.randrange(2) for x in ls]
        out.append((i, "\n".join(ls) + rnd.choice(["", "\n", "\r\n"])))
    long = "\n".join(["Line 1 of the pool", "unique"][k % 2] + ("" if k % 2 == 0 else str(k)) for k in range(40_000))
    return out + [(None, None), (None, ""), (None, "\n"), (500, long), (7, out[7][1]), (7, out[7][1]), (None, out[3][1]), (None, out[3][1])]


def test_lines_against_brute_force(llm):
    rows = line_rows()
    got = lines.drop_common_lines(llm.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    want = collections.Counter((i, *x) for (i, _), x in zip(rows, plain_lines([t for _, t in rows])))
    assert collections.Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got) == want
    assert sum(n for (_, _, d, _), n in want.items() if d) > 30
    got = lines.drop_common_lines(llm.createDataFrame(rows, "doc_id long, text string"), min_docs=3, min_chars=8).collect()
    want = collections.Counter((i, *x) for (i, _), x in zip(rows, plain_lines([t for _, t in rows], 3, 8)))
    assert collections.Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got) == want


def test_lines_on_odd_input(llm, odd_docs, no_docs):
    clash = odd_docs.withColumns({"n_lines": F.lit("x"), "kept_text": F.lit(1), "_id": F.lit(2), "_keys": F.lit(3), "_row": F.lit(4), "_t": F.lit(5)})
    got = lines.drop_common_lines(clash, min_docs=2)
    assert got.columns == [c for c in clash.columns if c not in lines.ADDED] + lines.ADDED
    rows = got.collect()
    assert len(rows) == odd_docs.count() and {(r._id, r._keys, r._row, r._t) for r in rows} == {(2, 3, 4, 5)}
    empty = next(r for r in rows if r.doc_id == 3)
    assert (empty.text, empty.n_lines, empty.n_dropped, empty.kept_text) == (None, 1, 0, "")
    assert lines.drop_common_lines(no_docs).collect() == []


def test_lines_plan_is_native(llm, sf_small):
    plan = lines.op13_line_dedup(llm, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan and "Cartesian" not in plan


# ---- spelling variants ---------------------------------------------------------

def plain_vocabulary(rows, alter=97, least=5, times=3):
    seen = collections.Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if alter and h % alter == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            seen[w] += 1
    return {w: n for w, n in seen.items() if len(w) >= least and n >= times}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain_variants(vocabulary):
    near = collections.defaultdict(list)
    for a in vocabulary:
        for b in vocabulary:
            if a < b and abs(len(a) - len(b)) < 2 and one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w, n in vocabulary.items():
        best = min(near[w], key=lambda x: (-vocabulary[x], x), default=None)
        form[w] = best if best is not None and vocabulary[best] >= 2 * n else None
    out = set()
    for w, n in vocabulary.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), vocabulary.get(form[w])))
    return out


def word_docs(seed=2):
    rnd = random.Random(seed)
    syllables = ["ta", "re", "no", "li", "su", "ou", "été", "ß", "z", "Ö", "×", "st"]
    words = ["".join(rnd.choices(syllables, k=rnd.randrange(2, 5))) for _ in range(150)]
    rows = [(i, " ".join(rnd.choice([w, w.upper(), w.capitalize()]) for w in rnd.choices(words, k=120)) + ".") for i in range(80)]
    rows += [(900, ("b" * 5000 + " ") * 3 + ("b" * 4999 + " ") * 7), (901, None), (None, "rerere " * 9), (None, ""), (3, rows[3][1]),
             (902, "日本 naïve1naïve2 x" * 4), (903, ("abcdefgh" * 9 + " ") * 200),
             (904, " ".join(("k" * k + " ") * 3 ** (k - 4) for k in range(5, 10)))]
    return rows


@pytest.mark.parametrize("part", [16384, 7])
def test_variants_against_brute_force(llm, part):
    rows = word_docs()
    docs = llm.createDataFrame(rows, "doc_id long, text string").repartition(3)
    vocabulary = plain_vocabulary(rows)
    words = variants.vocabulary(docs, alter=variants.ALTER)
    assert {(r.word, r.n) for r in words.collect()} == set(vocabulary.items())
    assert set(vocabulary) - set(plain_vocabulary(rows, alter=0))                 # altered runs are among them
    got = [tuple(r) for r in variants.spelling_variants(words, part=part).select(
        "word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got)) and set(got) == plain_variants(vocabulary)
    assert any(f is not None and r != f for _, f, r, *_ in got)                    # chains of more than one step


def test_variants_of_rearranged_letters(llm):
    """Words of equal letter counts, more than a part holds, in one leaf."""
    rnd = random.Random(4)
    words = {"".join(rnd.sample("aabbccdd", 8)): rnd.randrange(3, 90) for _ in range(200)}
    words |= {w[:3] + "d" + w[4:]: 5 for w in list(words)[:60]} | {w[:2] + w[3:]: 4 for w in list(words)[:40]}
    df = llm.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    got = {tuple(r) for r in variants.spelling_variants(df, part=20, groups=4).select(
        "word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == plain_variants(words)


def test_variants_on_odd_input(llm, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = variants.spelling_variants(variants.vocabulary(odd_docs)).collect()
    assert {(r.word, r.n) for r in got} == set(plain_vocabulary(rows, alter=0).items())
    assert variants.spelling_variants(variants.vocabulary(no_docs)).collect() == []


# ---- lexical search -------------------------------------------------------------

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(docs, items, k=10):
    found = [(i, TERM.findall((t or "").translate(LOW))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, w in found if w), sum(len(w) for _, w in found)
    counts = [(i, len(w), collections.Counter(w)) for i, w in found if w]
    df = collections.Counter(t for _, _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, n, c in counts:
            m = 100 - 90 + (90 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
                    for t in set(TERM.findall((text or "").translate(LOW))) if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def search_rows():
    rnd = random.Random(8)
    words = [f"w{k}" for k in range(150)] + ["Été", "日本語", "don't", "x_y", "ÉTÉ", "q\u0000r"]
    docs = [(i, " ".join(rnd.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=rnd.randrange(1, 60)))) for i in range(400)]
    docs += [(1000 + k, "w3 w3 w140 tie") for k in range(40)] + [(None, "w3 w3 w140 tie")] * 2 + [(None, None), (2000, ""), (2001, "--- !"), (5, docs[5][1])]
    items = [(f"i{k}", " ".join(rnd.choices(words, k=rnd.randrange(1, 25)))) for k in range(25)]
    return docs, items + [("tie", "TIE tie"), ("none", "zzz"), (None, "w1 w2"), ("null", None), ("i0", "w7"), ("i0", "w7")]


@pytest.mark.parametrize("how", [{}, {"group_terms": 20, "sizes": (3, 4, 17)}])
def test_search_against_brute_force(llm, how):
    docs, items = search_rows()
    got = lexical.search(llm.createDataFrame(docs, "doc_id long, text string").repartition(5),
                         llm.createDataFrame(items, "item_id string, text string"), **how)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_search(docs, items)


def test_search_on_odd_input(llm, odd_docs, no_docs):
    items = [("a", "the quick fox"), ("b", "line"), ("c", "spam")]
    it = llm.createDataFrame(items, "item_id string, text string")
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = lexical.search(odd_docs.withColumn("n", F.lit(1)).withColumn("terms", F.lit(1)), it)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_search(rows, items)
    assert lexical.search(no_docs, it).collect() == [] and lexical.search(odd_docs, it.limit(0)).collect() == []


def test_products_stay_exact():
    weight = np.array([28_000] * 5000, np.int64)
    for _, n, parts in lexical.item_tiles([np.arange(5000)] * 3, weight, 2, 10 ** 9):
        assert n in (1, 2) and all(28_000 * lexical.IMPACT_BOUND * len(own) < 2 ** 53 for own, _, _ in parts)
    tf, n = np.array([1, 10 ** 6]), np.array([1, 10 ** 9])
    assert (lexical.impacts(tf, n, 10, 10) < lexical.IMPACT_BOUND).all()
    assert lexical.impacts(np.array([3]), np.array([10 ** 9]), 10 ** 10, 10 ** 13).tolist() == [
        (1000000000 * 3) // (3000 + 8 * (10 + 90 * 10 ** 19 // 10 ** 13))]
