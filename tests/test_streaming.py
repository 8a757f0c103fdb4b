"""Row-bounded micro-batches, admission across restarts, observed counters."""

import os
import random
import tempfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.streaming import ingest as ST
from tessera.streaming.bounded import bounded_stream
from tessera.streaming.counters import Totals, observed_write


@pytest.fixture(scope="module")
def shipped(spark):
    from tessera.session import ship_package
    ship_package(spark)
    return spark


SCHEMA = "event_id long, user_id long, ts timestamp, tags array<string>"


def write_events(folder, name, ids, seed, row_group=11):
    rnd = random.Random(seed)
    rows = [{"event_id": i, "user_id": rnd.choice([None, *range(40)]), "ts": 1_700_000_000_000_000 + rnd.randrange(10 ** 9),
             "tags": rnd.choice([None, [], ["a", None]])} for i in ids]
    table = pa.Table.from_pylist(rows, pa.schema([("tags", pa.list_(pa.string())), ("event_id", pa.int64()), ("user_id", pa.int64()),
                                                  ("ts", pa.timestamp("us", "UTC"))]))
    pq.write_table(table, os.path.join(folder, name), row_group_size=row_group)
    return [(r["event_id"], r["user_id"], r["ts"]) for r in rows]


def plain_admitted(rows, bound, cuts=()):
    """First by (micro-batch, ts, event_id); a micro-batch never crosses a
    row of ``cuts`` (where a run had ended)."""
    batch, in_batch, seen = 0, 0, {}
    for k, (event, user, ts) in enumerate(rows):
        if in_batch == bound or k in cuts:
            batch, in_batch = batch + 1, 0
        in_batch += 1
        seen[user] = min(seen.get(user, (batch, ts, event)), (batch, ts, event))
    return sorted((x[2], u) for u, x in seen.items())


def test_micro_batches_hold_a_bounded_number_of_rows(shipped):
    folder = tempfile.mkdtemp(prefix="tessera-bounded-")
    rows = write_events(folder, "a.parquet", range(50), 1) + write_events(folder, "b.parquet", range(50, 53), 2)
    write_events(folder, "c.parquet", [], 3)
    rows += write_events(folder, "d.parquet", range(53, 140), 4)
    schema = shipped.createDataFrame([], SCHEMA).schema
    sink, batches = ST.run_stream(shipped, folder, schema, lambda s: s, max_rows=20, name="b")
    got = {r.batch: r.n for r in batches.collect()}
    assert got == {k: 20 for k in range(7)}
    out = shipped.read.parquet(sink)
    assert sorted(r.event_id for r in out.collect()) == list(range(140))
    by = {r.event_id: (r.user_id, r.tags) for r in out.collect()}
    assert all(by[i][0] == u for i, u, _ in rows) and {str(t) for _, t in by.values()} == {"None", "[]", "['a', None]"}
    order = {r.batch: sorted(x) for r in out.groupBy("batch").agg(F.collect_list("event_id").alias("x")).collect() for x in [r.x]}
    assert order == {k: list(range(20 * k, 20 * k + 20)) for k in range(7)}


def test_admission_goes_on_after_a_restart(shipped):
    folder, home = tempfile.mkdtemp(prefix="tessera-arrive-"), tempfile.mkdtemp(prefix="tessera-home-")
    schema = shipped.createDataFrame([], SCHEMA).schema
    rows = write_events(folder, "000.parquet", range(60), 5)
    ST.admit_first(shipped, folder, schema, ["user_id"], ["ts", "event_id"], max_rows=25, home=home)
    rows += write_events(folder, "001.parquet", range(60, 150), 6)
    got = ST.admit_first(shipped, folder, schema, ["user_id"], ["ts", "event_id"], max_rows=25, home=home)
    assert sorted((r.event_id, r.user_id) for r in got.collect()) == plain_admitted(rows, 25, {60})
    again = ST.admit_first(shipped, folder, schema, ["user_id"], ["ts", "event_id"], max_rows=25, home=home)
    assert sorted(r.event_id for r in again.collect()) == sorted(r.event_id for r in got.collect())


def test_a_failed_micro_batch_is_read_again(shipped):
    folder, home = tempfile.mkdtemp(prefix="tessera-fail-"), tempfile.mkdtemp(prefix="tessera-home-")
    schema = shipped.createDataFrame([], SCHEMA).schema
    rows = write_events(folder, "000.parquet", range(100), 7)
    failed = []

    def run(fail):
        def write(batch, epoch):
            if fail and epoch == 2:
                failed.append(epoch)
                raise RuntimeError("lost")
            batch.write.mode("overwrite").parquet(f"{home}/sink/batch={epoch}")

        q = (ST.first_rows(bounded_stream(shipped, folder, schema, 30), ["user_id"], ["ts", "event_id"])
             .writeStream.option("checkpointLocation", f"{home}/checkpoint").foreachBatch(write).start())
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    with pytest.raises(Exception):
        run(True)
    run(False)
    got = shipped.read.schema(schema).parquet(f"{home}/sink/batch=*").collect()
    assert failed == [2] and sorted((r.event_id, r.user_id) for r in got) == plain_admitted(rows, 30)


def test_observed_counts(shipped):
    df = shipped.range(1000).withColumn("ok", F.col("id") % 3 == 0)
    path = tempfile.mkdtemp(prefix="tessera-observed-") + "/out"
    got = observed_write(df, lambda x: x.write.parquet(path), rows=F.count(F.lit(1)), good=F.count_if("ok"))
    assert got == {"rows": 1000, "good": 334} and shipped.read.parquet(path).count() == 1000
    src = ST.stage_files(df, "observed", file_rows=90)
    totals = Totals("seen")
    ST.run_stream(shipped, src, df.schema, lambda s: s.observe("seen", F.count(F.lit(1)).alias("rows"), F.count_if("ok").alias("good")),
                  max_rows=150, totals=totals, name="observed")
    assert totals.wait() == {"rows": 1000, "good": 334} and len(totals.batches) == 7
