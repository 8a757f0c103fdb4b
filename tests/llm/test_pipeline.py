"""The pipeline against a plain version of its stages."""

from test_operators import brute_links

import corpus_pipeline as cp
from tessera.llm import decontam


def test_pipeline_against_plain_version(llm, sf_small):
    docs = llm.read.parquet(f"{sf_small}/documents.parquet")
    con_rows = {r.doc_id: r for r in docs.collect()}
    from tessera.llm import quality
    from tessera.plans.oracle_check import duck
    con = duck(sf_small)
    kept = [r[0] for r in con.execute(f"WITH {quality.metrics_sql()} SELECT doc_id FROM judged WHERE kept").fetchall()]
    stage = docs
    stage = cp.quality_rules(llm, docs, sf_small)
    assert stage.columns == docs.columns and sorted(r.doc_id for r in stage.collect()) == sorted(kept)
    groups = brute_links([(i, con_rows[i].text) for i in sorted(kept)])
    one = sorted(i for i, n, c in groups if i == c)
    windows = set()
    for r in llm.read.parquet(f"{sf_small}/benchmark.parquet").collect():
        windows |= set(decontam.windows(decontam.item_words(r.text)))
    sizes = {len(w) for w in windows}
    def clean(text):
        w = decontam.item_words(text)
        return not any(tuple(w[i:i + n]) in windows for n in sizes for i in range(len(w) - n + 1))
    final = sorted(i for i in one if clean(con_rows[i].text))
    got = cp.run(llm, sf_small).toPandas()
    assert sorted(got.doc_id) == final and 0 < len(final) < len(one) < len(kept) < len(con_rows)
    n = got.groupby("shard").size().reindex(range(40), fill_value=0)
    assert n.max() - n.min() <= 1


def test_stages_on_odd_input(llm, odd_docs, no_docs, sf_small):
    for name, stage in cp.STAGES[:-1]:
        for docs in (odd_docs, no_docs):
            out = stage(llm, docs, sf_small)
            assert out.columns == docs.columns
            assert out.count() <= docs.count()
    assert cp.STAGES[-1][1](llm, odd_docs, sf_small).count() == odd_docs.count()


def written(llm, docs, parts=3):
    import tempfile
    path = tempfile.mkdtemp(prefix="tessera-stage-") + "/docs"
    docs.coalesce(parts).write.parquet(path)
    return llm.read.parquet(path)


def test_the_mix_decides_the_slots(llm, sf_small):
    """Shards are dealt, and slots numbered, in the order that the mixing stage wrote."""
    from tessera.llm import mixing, sharding
    docs = llm.read.parquet(f"{sf_small}/documents.parquet").dropDuplicates(["text"])
    names = sorted({r.source for r in docs.collect()})
    seen = []
    for weights in ({names[0]: 1, names[1]: 1, names[2]: 8}, {n: 1 for n in names}, {names[-1]: 1}):
        mixed = written(llm, mixing.in_mix_order(docs, weights=weights))
        rows, order = sharding.file_order(mixed)
        want = [r.doc_id for r in sorted(rows.withColumn("o", order).collect(), key=lambda r: r.o)]
        got = {r.doc_id: r for r in cp.sharding_stage(llm, mixed, sf_small).collect()}
        by_shard = {}
        for i in want:
            by_shard.setdefault(got[i].shard, []).append(got[i].slot)
        assert all(x == list(range(len(x))) for x in by_shard.values())
        mix = {r.doc_id: (r.slot is None, r.slot, r.block, r.in_block) for r in mixing.mix_sources(docs, weights).collect()}
        assert want == sorted(want, key=lambda i: mix[i])
        seen.append({i: (r.shard, r.slot) for i, r in got.items()})
    assert seen[0] != seen[1] != seen[2]


def test_shared_lines_draw_documents_together(llm, sf_small):
    rows = [(i, (f"a long line that group {i % 60} has in common\n" if i < 240 else "") + f"own words {i}") for i in range(800)]
    docs = llm.createDataFrame(rows, "doc_id long, text string")
    linked = docs.select("doc_id", cp.shared_line().alias("k")).collect()
    got = {r.doc_id: r.shard for r in cp.sharding_stage(llm, written(llm, docs), sf_small).collect()}
    from tessera.llm import sharding
    alone = {r.doc_id: r.shard for r in sharding.shard_documents(docs).collect()}

    def cut(shard):
        by = {}
        for r in (r for r in linked if r.k is not None):
            by.setdefault(r.k, []).append(shard[r.doc_id])
        return sum(len(x) * len(x) - sum(x.count(s) ** 2 for s in set(x)) for x in by.values())
    assert cut(got) < 0.3 * cut(alone)
    sizes = [list(got.values()).count(s) for s in range(40)]
    assert max(sizes) - min(sizes) <= 1
    empty = docs.filter("doc_id IN (1, 8)").selectExpr("doc_id", "if(doc_id = 1, null, '') AS text")
    assert [r.k for r in empty.select(cp.shared_line().alias("k")).collect()] == [None, None]


def test_short_items_drop_nothing(llm):
    docs = llm.createDataFrame([(1, "the quick fox"), (2, "one two three four five six"), (3, None)], "doc_id long, text string")
    items = llm.createDataFrame([("a", "the"), ("b", "The-quick, fox"), ("c", "two three  four: five six"), ("d", None)], "item_id string, text string")
    assert sorted(r.doc_id for r in decontam.drop_leaks(docs, items).collect()) == [3]
    assert sorted(r.doc_id for r in decontam.drop_leaks(docs, items, min_words=5).collect()) == [1, 3]


def test_stages_keep_clashing_columns(llm, odd_docs, no_docs, sf_small):
    from pyspark.sql import functions as F
    clash = odd_docs.withColumns({c: F.lit(c) for c in ("_row", "_file", "_path", "_at", "_order", "_group", "shard", "slot", "_name", "kept", "n_words")})
    for name, stage in cp.STAGES[:-1]:
        out = stage(llm, written(llm, clash), sf_small)
        assert out.columns == clash.columns and out.select(clash.columns).exceptAll(clash).count() == 0, name
    last = cp.STAGES[-1][1]
    assert last(llm, written(llm, clash), sf_small).count() == odd_docs.count()
    assert last(llm, written(llm, no_docs), sf_small).count() == 0 and last(llm, no_docs, sf_small).count() == 0
