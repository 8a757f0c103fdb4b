"""File sources and sinks: prompt CSV, annotation JSONL/JSON, media
listings and payloads, media-reference parsing."""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.chat import canonical_from_variant
from ..session import ensure_checkpoint_dir
from ..streaming.bounded import _open

#: files of one subfolder of a written media folder
FOLDER_FILES = 1000

PROMPT_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("prompt", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("width", T.LongType()),
    T.StructField("height", T.LongType()),
    T.StructField("source_site", T.StringType()),
])
SCORED_SCHEMA = T.StructType(PROMPT_SCHEMA.fields + [T.StructField("similarity", T.DoubleType())])


def read_prompt_csv(spark: SparkSession, path: str, schema: T.StructType = PROMPT_SCHEMA,
                    required: tuple = ("id", "prompt", "url")) -> DataFrame:
    """Prompt CSV by its header: the columns of ``schema`` are found by name
    and typed, all others follow as text; a missing one is null, or an error
    if it is ``required``.  Prompts
    may hold newlines, commas and doubled quotes, so a file is read by one
    task; a large corpus comes as many files or as Parquet."""
    raw = (spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
           .csv(path))
    missing = [c for c in required if c not in raw.columns]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    known = {f.name for f in schema}
    found = lambda c: F.col(f"`{c}`") if c in raw.columns else F.lit(None).cast("string")
    return raw.select(*[found(f.name).try_cast(f.dataType).alias(f.name) for f in schema],
                      *[F.col(f"`{c}`") for c in raw.columns if c not in known])


def write_csv(df: DataFrame, path: str, partition_by: str | None = "split") -> None:
    """CSV with header, one folder per split (written once, overwrite)."""
    w = (df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    if partition_by:
        w = w.partitionBy(partition_by)
    w.csv(path)


# ---------------------------------------------------------------- annotations
def numbered_records(lines: DataFrame, file: str = "source_file", block: str = "_block") -> DataFrame:
    """Add ``record``: the 0-based place of each line among all lines, files
    by path, lines as they stand in the file.

    A scan task reads its splits line after line, so a line's place is its
    place within its split and the number of lines in the splits before it
    (``block``: where the split begins in its file).  The lines are written to
    the checkpoint folder with the scan's own count, so that the numbers stay
    as they are when a task runs again on other splits.  Beyond that only a
    table with one row for each split is summed up; no line is sorted or
    moved."""
    ensure_checkpoint_dir(lines.sparkSession)
    read = lines.withColumns({"_split": F.xxhash64(file, block), "_seen": F.monotonically_increasing_id()}).checkpoint(eager=True)
    splits = read.groupBy("_split").agg(F.min(file).alias("_f"), F.min(block).alias("_b"), F.min("_seen").alias("_first"),
                                        F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)
    # one narrow row for each split: bounded by the number of scan tasks
    base = F.broadcast(splits.select("_split", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_base")))
    return (read.join(base, "_split").withColumn("record", (F.col("_seen") + F.col("_base")).cast("bigint"))
            .drop("_split", "_seen", "_base", block))


def annotation_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw annotation documents, one per row: source_file, record (their
    place in the list of all records, which is what a record without an id is
    known by), line (JSONL only) and the parsed v.

    ``.jsonl`` files are read line by line as text and parsed as VARIANT
    (``read.json`` would split a top-level array into several rows);
    ``.json`` files hold one JSON array of records and are read whole, each
    by one task, then exploded: a large corpus is converted to lines first.
    Other extensions are rejected.
    """
    if path.endswith(".json"):
        raw = spark.read.format("text").option("wholetext", True).load(path)
        docs = raw.select(F.col("_metadata.file_path").alias("source_file"), F.lit(0).alias("_block"),
                          F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>").alias("_docs"))
        return numbered_records(docs.select("source_file", "_block", F.explode("_docs").alias("v")))
    if path.endswith(".jsonl") or not path.rsplit("/", 1)[-1].count("."):
        raw = spark.read.text(path).select(
            F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_block"),
            F.col("value").alias("line"))
        return numbered_records(raw.filter(F.trim("line") != "")).withColumn("v", F.try_parse_json("line"))
    raise ValueError("annotation files must be .json or .jsonl")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Canonical records: record (place in the list), id (null where it has
    none), turns (role, content), images, videos.  Unparseable lines come back
    with a null ``turns`` for routing to the problem set."""
    lines = annotation_lines(spark, path)
    cols = canonical_from_variant("v")
    return lines.select("source_file", "record", "v", *[c.alias(n) for n, c in cols.items()])


def write_jsonl(df: DataFrame, json_col: str, path: str) -> None:
    """One JSON document per line (``to_json`` string column)."""
    df.select(F.col(json_col).alias("value")).write.mode("overwrite").text(path)


# ---------------------------------------------------------------- media
def media_manifest(manifest: DataFrame, path: str = "path", length: str = "length") -> DataFrame:
    """Existing media files from a manifest table (path, length), which needs
    no folder listing on the driver: the choice for very many files."""
    return manifest.select(F.col(path).alias("path"), F.col(length).cast("bigint").alias("length"))


def _write_files(folder: str):
    def run(batches):
        system, root = _open(folder)
        context = TaskContext.get()
        task, attempt, n = context.partitionId(), context.taskAttemptId(), 0
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content")):
                if not content.is_valid:
                    continue
                k, at = divmod(n, FOLDER_FILES)
                inside = f"{root}/{task:05d}-{k:05d}"
                if not at:
                    system.create_dir(inside)
                aside = f"{inside}/.{at}-{attempt}"              # a file is there whole or not at all
                with system.open_output_stream(aside, compression=None) as f:
                    f.write(content.as_buffer())
                system.move(aside, f"{inside}/{at:03d}-{name or ''}")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])
    return run


def write_media(files: DataFrame, folder: str) -> int:
    """Write each row (name, content binary) as one file below ``folder`` and
    return their number; a null content is no file.

    A task writes its own rows, ``FOLDER_FILES`` to a subfolder, so nothing is
    moved at the end of the job and the subfolders are listed side by side.  A
    file is ``<task>-<subfolder>/<place>-<name>``: rows of equal name are files
    of their own.  A task that runs again writes the same files, so rows must
    come in the same order then (a scan, or sorted rows)."""
    system, root = _open(folder)
    system.create_dir(root)
    return files.select("name", "content").mapInArrow(_write_files(folder), "n long").agg(
        F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _media_files(spark: SparkSession, folder: str, glob: str | None, files: int | None) -> DataFrame:
    r = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        r = r.option("pathGlobFilter", glob)
    found = r.load(folder)
    # Spark reckons every file as megabytes, which makes a task of a few small ones
    return found if files is None else found.coalesce(max(spark.sparkContext.defaultParallelism, -(-files // FOLDER_FILES)))


def media_listing(spark: SparkSession, folder: str, glob: str | None = None, files: int | None = None) -> DataFrame:
    """Existing media files: path, length, modificationTime (the content
    column is pruned, so no file body is read).  With their number ``files``,
    a task takes about ``FOLDER_FILES`` of them."""
    return _media_files(spark, folder, glob, files).select("path", "length", "modificationTime")


def media_payloads(spark: SparkSession, folder: str, glob: str | None = None, files: int | None = None) -> DataFrame:
    return _media_files(spark, folder, glob, files).select("path", "length", "content")


def media_scheme(ref) -> Column:
    r = F.col(ref) if isinstance(ref, str) else ref
    return (F.when(r.startswith("http://") | r.startswith("https://"), "http")
            .when(r.startswith("file://"), "file")
            .when(r.startswith("data:image") & r.contains("base64,"), "data")
            .otherwise("path"))


def media_local_path(ref) -> Column:
    r = F.col(ref) if isinstance(ref, str) else ref
    return (F.when(r.startswith("file://"), F.substring(r, 8, 1 << 30))
            .when(media_scheme(r) == "path", r))


def data_uri_payload(ref) -> Column:
    r = F.col(ref) if isinstance(ref, str) else ref
    return F.when(media_scheme(r) == "data", F.unbase64(F.split(r, "base64,", 2)[1]))


def url_ext(url, default: str = ".png") -> Column:
    """Extension of the url path with the query string dropped."""
    u = F.col(url) if isinstance(url, str) else url
    path = F.substring_index(u, "?", 1)
    # splitext: leading dots of the last segment never start an extension
    last = F.regexp_replace(F.substring_index(path, "/", -1), r"^\.+", "")
    ext = F.regexp_extract(last, r"(\.[^.]*)$", 1)
    return F.coalesce(F.nullif(ext, F.lit("")), F.lit(default))


def base64_text(binary) -> Column:
    """Base64 without the line breaks Spark inserts in long output."""
    b = F.col(binary) if isinstance(binary, str) else binary
    return F.translate(F.base64(b), "\r\n", "")
