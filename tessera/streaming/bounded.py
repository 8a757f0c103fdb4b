"""A stream source that limits a micro-batch by rows.

The reference keeps at most 150 items in flight.  Spark's file source limits
files or bytes; this one (a Python data source) gives every micro-batch at
most ``max_rows`` rows of a folder of Parquet files, whatever the size of the
files.  An offset is a place in the folder - a file name and a row in it - so
a micro-batch can be read again after a restart, and only the footers of the
files that a micro-batch touches are read to plan it.  Files are taken in the
order of their names; those that arrive later must have later names, as the
files of one Spark write and folders named by time have.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

MAX_ROWS = 150


def _open(path: str):
    """(file system, path in it); Spark writes local paths as ``file:/...``."""
    uri = re.sub(r"^file:/(?!//)", "file:///", path)
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


class Piece(InputPartition):
    """Rows ``first`` to ``end`` of a file."""

    def __init__(self, path: str, first: int, end: int):
        self.path, self.first, self.end = path, first, end


class BoundedRows(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bounded_rows"

    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(self.options["row_schema"]))

    def streamReader(self, schema: StructType) -> "BoundedReader":
        return BoundedReader(self.options["path"], int(self.options.get("max_rows", MAX_ROWS)), schema)


class BoundedReader(DataSourceStreamReader):
    def __init__(self, folder: str, max_rows: int, schema: StructType):
        if max_rows < 1:
            raise ValueError("max_rows must be at least 1")
        self.folder, self.max_rows, self.arrow = folder, max_rows, to_arrow_schema(schema)
        self.at: dict | None = None

    def _files(self, first: str) -> list[str]:
        system, path = _open(self.folder)
        found = system.get_file_info(fs.FileSelector(path, recursive=False))
        return sorted(f.base_name for f in found if f.is_file and f.base_name.endswith(".parquet") and f.base_name >= first)

    def _rows(self, name: str) -> int:
        system, path = _open(f"{self.folder.rstrip('/')}/{name}")
        with system.open_input_file(path) as f:
            return pq.ParquetFile(f).metadata.num_rows

    def _pieces(self, start: dict, limit: int | None = None, end: dict | None = None):
        """(file, first row, end row) from ``start`` on: ``limit`` rows, or up to ``end``."""
        for name in self._files(start["file"]):
            if limit == 0 or end and name > end["file"]:
                return
            first = start["row"] if name == start["file"] else 0
            stop = end["row"] if end and name == end["file"] else self._rows(name)
            if limit is not None:
                stop = min(stop, first + limit)
                limit -= max(0, stop - first)
            if stop > first:
                yield name, first, stop

    def initialOffset(self) -> dict:
        return {"file": "", "row": 0}

    def latestOffset(self) -> dict:
        at = self.at or self.initialOffset()
        for name, _, stop in self._pieces(at, limit=self.max_rows):
            at = {"file": name, "row": stop}
        self.at = at
        return at

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        if self.at is None:                     # after a restart the last planned micro-batch comes first
            self.at = end
        return [Piece(f"{self.folder.rstrip('/')}/{name}", a, b) for name, a, b in self._pieces(start, end=end)]

    def read(self, partition: Piece):
        system, path = _open(partition.path)
        with system.open_input_file(path) as f:
            source, at = pq.ParquetFile(f), 0
            for group in range(source.metadata.num_row_groups):
                n = source.metadata.row_group(group).num_rows
                if at < partition.end and at + n > partition.first:
                    row = at
                    for batch in source.iter_batches(row_groups=[group], columns=self.arrow.names):
                        lo, hi = max(partition.first - row, 0), min(partition.end - row, batch.num_rows)
                        row += batch.num_rows
                        if hi > lo:
                            table = pa.Table.from_batches([batch.slice(lo, hi - lo)]).select(self.arrow.names)
                            yield from table.cast(self.arrow).to_batches()
                at += n


def bounded_stream(spark: SparkSession, folder: str, schema: StructType, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of a folder of Parquet files as a stream of micro-batches of
    at most ``max_rows`` rows."""
    spark.dataSource.register(BoundedRows)
    return (spark.readStream.format("bounded_rows").option("row_schema", schema.json())
            .option("max_rows", max_rows).load(folder))
