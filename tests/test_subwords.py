"""Ranked pair merges against a tokenizer library."""

import random

import pytest
from pyspark.sql import functions as F

from tessera import api
from tessera.operators import subwords as SW

tokenizers = pytest.importorskip("tokenizers")
vocabularies = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def path():
    return vocabularies.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library(path):
    t = tokenizers.Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def texts(spark, sf_small):
    from tessera.session import ship_package
    ship_package(spark)
    rnd = random.Random(9)
    odd = ["", " ", "\n\n  \t", "  lead", "trail  ", "a  b   c\n\n d", "don't I'll we've 'S 's", "aaaaaaaaa" * 7, "naïve café 日本語 ",
           "😀😀 mixed😀text", "x" * 3000, "<|endoftext|> here", "tab\tnbsp thin end", "\u0000\u0001 ctrl", "1234567 12.5%",
           "ÀÉß ǅ ﬁ", "".join(rnd.choice("abcdefghij ABC.,;!?\n0123é日😀") for _ in range(4000)), "日" * 120, "é" * 200, "😀" * 90]
    odd += ["".join(rnd.choice("etaoin shrdlu\n'.é") for _ in range(rnd.randrange(300))) for _ in range(200)]
    prompts = [r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    return prompts + odd


@pytest.fixture(scope="module")
def table(spark, texts):
    return spark.createDataFrame([*enumerate(texts), (-1, None)], "id long, prompt string").repartition(4)


def test_ids_and_counts_equal_the_tokenizer(table, texts, library, path):
    want = {i: e.ids for i, e in enumerate(library.encode_batch(texts, add_special_tokens=False))}
    got = {r.id: r.n_tokens for r in SW.subword_counts(table, path).collect()}
    assert got == {i: len(x) for i, x in want.items()} | {-1: 0}
    rows = SW.subword_ids(table, path).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("x")).collect()
    assert {r.id: [t.token for t in r.x] for r in rows} == {i: x for i, x in want.items() if x}
    assert all([t.pos for t in r.x] == list(range(len(r.x))) for r in rows)


@pytest.mark.parametrize("least,most", [(55, 77), (0, 5), (10, 3)])
def test_truncation_equals_the_tokenizer(table, texts, library, path, least, most):
    got = {r.id: r.truncated for r in SW.truncate_subwords(table, path, min_tokens=least, max_tokens=most).collect()}
    want = {}
    for i, e in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        if len(e.ids) >= least:
            want[i] = library.decode(e.ids[:most], skip_special_tokens=False).strip()
    assert {i: x for i, x in got.items() if i >= 0} == want and (-1 in got) == (least == 0)


def test_convert_with_a_vocabulary(spark, library, path):
    rows = [(i, "word " * n, f"u{i}") for i, n in enumerate((10, 54, 55, 120))]
    df = spark.createDataFrame(rows, "id long, prompt string, url string")
    got = {r.id: r.json for r in api.convert(df, vocabulary=path).collect()}
    want = {i for i, p, _ in rows if len(library.encode(p).ids) >= 55}
    assert set(got) == want and all("Enhanced Prompt: 'word" in x for x in got.values())


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        SW.Merges(vocabularies.path("word_bpe_49k.json"))


def _by_text(rows):
    got = {}
    for r in rows:
        got.setdefault(r.id, []).append((r.pos, r.token))
    return {i: [t for _, t in sorted(x)] for i, x in got.items() if [p for p, _ in sorted(x)] == list(range(len(x)))}


@pytest.mark.parametrize("pieces,rows", [(1, 1), (50, 7), (1 << 20, 1 << 18)])
def test_ids_leave_the_task_that_reads_the_text(spark, texts, library, path, monkeypatch, pieces, rows):
    monkeypatch.setattr(SW, "TEXT_PIECES", pieces)
    monkeypatch.setattr(SW, "OUT_ROWS", rows)
    some = ["", *texts[-60:], "", texts[0], ""]
    df = spark.createDataFrame([*enumerate(some), (-1, None)], "id long, prompt string").repartition(2)
    ids = SW.subword_ids(df, path)
    plan = ids._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Sort" not in plan and "Join" not in plan       # a row for each token is not moved
    assert _by_text(ids.collect()) == {i: e.ids for i, e in enumerate(library.encode_batch(some, add_special_tokens=False)) if e.ids}


def test_ids_of_empty_texts_and_of_repeated_keys(spark, library, path):
    empty = spark.createDataFrame([(1, ""), (2, None)], "id long, prompt string")
    assert SW.subword_ids(empty, path).collect() == [] and SW.subword_ids(empty.limit(0), path).collect() == []
    twice = spark.createDataFrame([(1, "one two"), (2, "a b c"), (2, "a b c"), (None, "x y"), (None, "x y")], "id long, prompt string")
    got = _by_text(SW.subword_ids(twice, path).collect())
    one, two, none = (library.encode(x).ids for x in ("one two", "a b c", "x y"))
    assert [len(x) for x in (one, two, none)] == [2, 3, 2]
    assert got == {1: one, 2: [t for t in two for _ in "ab"], None: [t for t in none for _ in "ab"]}
