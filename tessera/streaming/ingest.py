"""Throttled streaming ingest and scoring.

A bounded producer/consumer becomes a stream with a limit on what a
micro-batch holds: rows (``bounded``), or bytes or files of the file source;
scoring is a stateless expression inside the stream; progress counters are
observed on the rows as they pass (``counters``), or are a complete-mode
aggregation over a handful of status keys; the rows of each micro-batch stay
readable from the sink's folders.  A query ends when everything staged has
been drained.  Skip-if-seen keeps the keys it has admitted in the state store.
"""

from __future__ import annotations

from typing import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import scratch_path
from .bounded import bounded_stream
from .counters import Totals

MAX_BYTES = 64 << 20
FILE_ROWS = 1_000_000


def stage_files(df: DataFrame, name: str, file_rows: int = FILE_ROWS, order: list[str] | None = None) -> str:
    """Write ``df`` as parquet files of at most ``file_rows`` rows, by as many
    tasks as its input has partitions: the arrival folder.  With ``order``
    the rows arrive in that order, file after file."""
    path = scratch_path(df.sparkSession, name)
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    df.write.option("maxRecordsPerFile", file_rows).mode("overwrite").parquet(path)
    return path


def _source(spark: SparkSession, src: str, schema, max_bytes: int, max_files: int | None, max_rows: int | None) -> DataFrame:
    if max_rows:
        return bounded_stream(spark, src, schema, max_rows)
    r = spark.readStream.schema(schema)
    # one limit at a time: by bytes, or by files where the caller asks for it
    r = r.option("maxFilesPerTrigger", max_files) if max_files else r.option("maxBytesPerTrigger", max_bytes)
    return r.parquet(src)


def _drained(writer, by_rows: bool) -> StreamingQuery:
    """Run a stream until all that has been staged is through."""
    if not by_rows:
        q = writer.trigger(availableNow=True).start()
        q.awaitTermination()
        return q
    q = writer.start()              # the source itself says how far a micro-batch goes
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return q


def run_stream(spark: SparkSession, src: str, schema, transform: Callable[[DataFrame], DataFrame],
               max_bytes: int = MAX_BYTES, max_files_per_trigger: int | None = None, output_mode: str = "append",
               name: str = "stream", max_rows: int | None = None,
               totals: Totals | None = None) -> tuple[str, DataFrame | None]:
    """Drain ``src`` through ``transform`` in bounded micro-batches; each
    micro-batch lands in its own ``batch=<id>`` folder of a parquet sink
    (foreachBatch, exactly once under replays).  Returns the sink path and,
    in append mode, the rows of every micro-batch (batch, n), read from the
    sink, so it is complete however long the stream was.  ``totals`` gets
    the counts that ``transform`` observes under its name."""
    sink = scratch_path(spark, f"{name}-sink")
    ckpt = scratch_path(spark, f"{name}-ckpt")
    out = transform(_source(spark, src, schema, max_bytes, max_files_per_trigger, max_rows))

    def write(batch: DataFrame, epoch: int) -> None:
        # idempotent under replays: a re-run micro-batch overwrites its own
        # folder; complete mode replaces the whole result each time
        if output_mode == "complete":
            batch.write.mode("overwrite").parquet(sink)
        else:
            batch.write.mode("overwrite").parquet(f"{sink}/batch={epoch}")

    if totals:
        spark.streams.addListener(totals)
    _drained(out.writeStream.outputMode(output_mode).option("checkpointLocation", ckpt).foreachBatch(write), bool(max_rows))
    if totals:
        totals.wait()
        spark.streams.removeListener(totals)
    if output_mode == "complete":
        return sink, None
    return sink, spark.read.parquet(sink).groupBy("batch").agg(F.count(F.lit(1)).alias("n"))


def first_rows(stream: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of each key the least row by ``order`` of the micro-batch in which it
    first appears.  The state store remembers that a key was admitted - one
    flag a key, looked up once for each key of a micro-batch - so the work
    does not grow with what has passed before."""
    schema = stream.schema

    def admit(k: tuple, parts, state: GroupState):
        if state.exists:
            return
        best = None
        for part in parts:                      # a hot key comes in several parts
            part = part if best is None else pd.concat([best, part])
            best = part.sort_values(order, kind="stable").head(1)
        state.update((True,))
        yield best

    return stream.groupBy(*key).applyInPandasWithState(admit, schema, "admitted boolean", "append", GroupStateTimeout.NoTimeout)


def admit_first(spark: SparkSession, src: str, schema, key: list[str], order: list[str], max_bytes: int = MAX_BYTES,
                max_files_per_trigger: int | None = None, name: str = "admit", max_rows: int | None = None,
                home: str | None = None) -> DataFrame:
    """Skip-if-seen: the first arrival of each key, over the whole stream.

    With ``home`` (a shared folder) the sink and the stream's checkpoint stay
    there: a later call, also in another application, goes on after the last
    micro-batch and still knows every key.  A replayed micro-batch overwrites
    its own folder of the sink."""
    home = home or scratch_path(spark, name)
    sink = f"{home}/sink"
    out = first_rows(_source(spark, src, schema, max_bytes, max_files_per_trigger, max_rows), key, order)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={epoch}")

    _drained(out.writeStream.option("checkpointLocation", f"{home}/checkpoint").foreachBatch(write), bool(max_rows))
    return spark.read.schema(schema).option("basePath", sink).parquet(f"{sink}/batch=*")
