"""Subword tokens by ranked pair merges (byte-level BPE).

The vocabulary is a file of the public ``tokenizers`` format whose path the
caller gives: ids of the pieces, and the pairs that may be merged in the order
of their ranks.  Nothing of a tokenizer library runs here:

 1. texts are cut into pieces (a word with the blank before it, a run of
    digits, of signs, of white space) by one JVM pattern;
 2. the distinct pieces of all texts are split once.  A task starts with the
    bytes of its pieces and repeats, for all of them side by side: look up the
    rank of every neighbouring pair in the sorted merge table, take the lowest
    of each piece, merge it wherever it stands.  A piece leaves when none of its
    pairs is in the table.  (The same as joins with the merge table in as many
    rounds as a word has merges, but in one stage.)  The merge table, some
    50,000 rows by the vocabulary and never by the data, is broadcast;
 3. counts come back to the texts by a join on the piece; Spark
    broadcasts the pieces or splits hot ones by their size, as they are saved.

Ids have a row for each token, many times the rows of the texts, so they are
not dealt or sorted: the pieces of a text stay together, the distinct ones of
some texts are split side by side as in 2, and the rows leave the task in their
order.  Only texts whose key is found more than once come by a join and by
prefix sums over all pieces of their key.

A text cut to its first ``n`` tokens is a byte prefix of the text, so only the
length of that prefix is worked out, from the leading ``n`` pieces (each has a
token at least).

Names of special tokens in a text are ordinary text.  A null text has no
tokens; keys must be unique and not null.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import scratch_path
from .rows import running_sums
from .text import MAX_TOKENS, MIN_TOKENS

#: fixed value: the pattern of pieces that belongs to this kind of vocabulary
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MAX_MERGES = 1 << 20         # a larger merge table is no vocabulary; it would not be broadcast
_NEVER = np.int64(1) << 40
TEXT_PIECES = 1 << 20        # pieces of texts that are split side by side
OUT_ROWS = 1 << 18           # rows of ids that leave a task at once


def byte_characters() -> list[str]:
    """The character that stands for each byte in the file: printable bytes
    for themselves, the others by the characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    names = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [names[b] for b in range(256)]


class Merges:
    """The merge table: pairs of ids, sorted, with rank and merged id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        if model.get("end_of_word_suffix") or model.get("continuing_subword_prefix"):
            raise ValueError(f"{path}: not a byte-level vocabulary")
        ids = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if len(pairs) > MAX_MERGES:
            raise ValueError(f"{path}: more than {MAX_MERGES} merges")
        self.size = max(ids.values()) + 1
        key = np.array([ids[a] * self.size + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.first = np.array([ids[c] for c in byte_characters()], np.int64)
        self.key, self.rank = key[order], order.astype(np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)[order]

    def split(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of the pieces in a block of bytes: (ids, bytes of each,
        first token of each piece)."""
        piece = np.repeat(np.arange(len(off) - 1), np.diff(off))
        token, width = self.first[raw], np.ones(len(raw), np.int64)
        done = []
        while len(token):
            key = token[:-1] * self.size + token[1:]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            ok = (self.key[at] == key) & (piece[1:] == piece[:-1])
            rank = np.append(np.where(ok, self.rank[at], _NEVER), _NEVER)
            head = np.concatenate(([True], piece[1:] != piece[:-1]))
            best = np.minimum.reduceat(rank, np.flatnonzero(head))[np.cumsum(head) - 1]
            live = best < _NEVER
            done.append((piece[~live], token[~live], width[~live]))
            here = np.flatnonzero(live & (rank == best))
            run = np.concatenate(([True], np.diff(here) != 1))          # aaa: the first two merge, not the last
            start = np.flatnonzero(run)[np.cumsum(run) - 1] if len(here) else here
            here = here[(np.arange(len(here)) - start) % 2 == 0]
            token[here] = self.merged[at[here]]
            width[here] += width[here + 1]
            live[here + 1] = False
            piece, token, width = piece[live], token[live], width[live]
        piece, token, width = (np.concatenate(x) for x in zip(*done)) if done else (piece, token, width)
        order = np.argsort(piece, kind="stable")
        return token[order], width[order], np.searchsorted(piece[order], np.arange(len(off)))


def _split_column(merges: Merges, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return merges.split(raw[off[0]:off[-1]], off - off[0])


def _split_pieces(shared):
    def run(batches):
        merges = shared.value
        for batch in batches:
            ids, width, first = _split_column(merges, batch.column("piece"))
            lists = [pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(x, pa.int32())) for x in (ids, width)]
            yield pa.RecordBatch.from_arrays([batch.column("piece"), *lists], names=["piece", "ids", "widths"])
    return run


def _text_ids(shared, key: str):
    """Rows (key, pos, token) from texts as lists of pieces."""
    def run(batches):
        merges = shared.value
        for batch in batches:
            lists = batch.column("_pieces")
            end = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            i = 0
            while i < len(end):
                # some texts at a time, by the number of their pieces
                before = end[i - 1] if i else 0
                j = max(i + 1, int(np.searchsorted(end, before + TEXT_PIECES, "right")))
                found = lists.slice(i, j - i).flatten().dictionary_encode()
                ids, _, first = _split_column(merges, found.dictionary)
                at = found.indices.to_numpy()
                size = np.diff(first)[at]
                edge = np.concatenate(([0], np.cumsum(size)))               # where each piece begins among all tokens
                text = edge[np.concatenate(([before], end[i:j])) - before]  # and each text
                row = np.repeat(np.arange(i, j), np.diff(text))
                for a in range(0, int(edge[-1]), OUT_ROWS):
                    b = min(a + OUT_ROWS, int(edge[-1]))
                    n = np.arange(a, b)
                    piece = np.searchsorted(edge, n, "right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(key).take(pa.array(row[a:b])), pa.array(n - text[row[a:b] - i]),
                         pa.array(ids[first[at[piece]] + n - edge[piece]])], names=[key, "pos", "token"])
                i = j
    return run


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?U){PIECES}"), F.lit(0))


def leading_pieces(text: Column, n: int) -> Column:
    """The first ``n`` pieces; the rest of the text is not looked at."""
    return pieces(F.regexp_extract(F.coalesce(text, F.lit("")), rf"(?U)\A(?:{PIECES}){{0,{n}}}+", 0))


def piece_tokens(found: DataFrame, vocabulary: str) -> DataFrame:
    """Saved (piece, ids, widths) of the distinct pieces in ``found``."""
    spark = found.sparkSession
    shared = spark.sparkContext.broadcast(Merges(vocabulary))
    path = scratch_path(spark, "pieces")
    found.select("piece").distinct().mapInArrow(_split_pieces(shared), "piece string, ids array<int>, widths array<int>") \
        .write.parquet(path)
    return spark.read.schema("piece string, ids array<int>, widths array<int>").parquet(path)


def subword_counts(df: DataFrame, vocabulary: str, key: str = "id", text: str = "prompt") -> DataFrame:
    """(key, n_tokens) of every text."""
    found = df.select(key, F.explode_outer(pieces(F.col(text))).alias("piece"))
    split = piece_tokens(found.filter("piece IS NOT NULL"), vocabulary).select("piece", F.size("ids").alias("_n"))
    return found.join(split, "piece", "left").groupBy(key).agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("n_tokens"))


def subword_ids(df: DataFrame, vocabulary: str, key: str = "id", text: str = "prompt") -> DataFrame:
    """(key, pos, token): the token ids of every text.  The pieces of equal
    keys are numbered together, by their place in their text."""
    spark = df.sparkSession
    path = scratch_path(spark, "repeated-keys")
    df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_key").write.parquet(path)
    repeated = spark.read.parquet(path)
    if repeated.isEmpty():
        return _ids_by_text(df, vocabulary, key, text)
    same = F.col(key).eqNullSafe(F.col("_key"))
    return _ids_by_text(df.join(repeated, same, "left_anti"), vocabulary, key, text).unionByName(
        _ids_by_key(df.join(repeated, same, "left_semi"), vocabulary, key, text))


def _ids_by_text(df: DataFrame, vocabulary: str, key: str, text: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(Merges(vocabulary))
    kind = df.schema[key].dataType.simpleString()
    return df.select(key, pieces(F.col(text)).alias("_pieces")).mapInArrow(
        _text_ids(shared, key), f"`{key}` {kind}, pos long, token long")


def _ids_by_key(df: DataFrame, vocabulary: str, key: str, text: str) -> DataFrame:
    found = df.select(key, F.posexplode(pieces(F.col(text))).alias("_at", "piece"))
    split = piece_tokens(found, vocabulary).select("piece", "ids")
    x = running_sums(found.join(split, "piece"), ["_at"], [key], {"_first": F.size("ids").cast("bigint")})
    x = x.select(key, "_first", F.posexplode("ids").alias("_k", "token"))
    return x.select(key, (F.col("_first") + F.col("_k")).cast("bigint").alias("pos"), F.col("token").cast("bigint").alias("token"))


#: bytes of the first ``_max`` tokens, from the (place, widths) of the leading pieces
_PREFIX = """
aggregate(_p, named_struct('n', 0, 'b', 0), (a, p) -> named_struct(
  'n', a.n + size(p.widths),
  'b', a.b + aggregate(slice(p.widths, 1, greatest(least(size(p.widths), {n} - a.n), 0)), 0, (s, w) -> s + w)), a -> a.b)
"""


def truncate_subwords(df: DataFrame, vocabulary: str, key: str = "id", text: str = "prompt", min_tokens: int = MIN_TOKENS,
                      max_tokens: int = MAX_TOKENS, out: str = "truncated") -> DataFrame:
    """The rows of ``df`` with at least ``min_tokens`` tokens, and ``out``:
    their first ``max_tokens`` tokens as text, stripped.  Both need only the
    leading pieces of a text.  A letter that the cut goes through becomes
    U+FFFD, as it does in a decoder."""
    n = max(min_tokens, max_tokens)
    found = df.select(key, F.posexplode(leading_pieces(F.col(text), n)).alias("_at", "piece"))
    split = piece_tokens(found, vocabulary).select("piece", "widths")
    lead = found.join(split, "piece").groupBy(F.col(key).alias("_key")).agg(
        F.sort_array(F.collect_list(F.struct("_at", "widths"))).alias("_p"))            # at most n pieces
    lead = lead.select("_key", F.expr(_PREFIX.format(n=int(max_tokens))).alias("_bytes"),
                       F.expr("aggregate(_p, 0, (a, p) -> a + size(p.widths))").alias("_n"))
    x = df.join(lead, F.col(key) == F.col("_key")) if min_tokens > 0 else df.join(lead, F.col(key) == F.col("_key"), "left")
    if min_tokens > 0:
        x = x.filter(F.col("_n") >= min_tokens)
    cut = F.expr(f"make_valid_utf8(CAST(substring(CAST(`{text}` AS BINARY), 1, coalesce(_bytes, 0)) AS STRING))")
    return x.withColumn(out, T.strip_ws(cut)).drop("_key", "_bytes", "_n")
