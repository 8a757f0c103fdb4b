"""Text preparation: token filters, truncation, whitespace normalisation,
marker extraction, projections with defaults, failure drops, run summary."""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tokens import Tokenizer, whitespace_tokenizer

# Fixed values of the reference's prompt preparation.
MIN_TOKENS = 55
MAX_TOKENS = 77
MIN_WORDS = 25
MARKER = "Enhanced Prompt:"


def token_count(col, tokenizer: Tokenizer = whitespace_tokenizer) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.size(tokenizer(c)).cast("bigint")


def min_token_filter(df: DataFrame, col: str = "prompt", min_tokens: int = MIN_TOKENS,
                     tokenizer: Tokenizer = whitespace_tokenizer, out: str | None = "n_tokens") -> DataFrame:
    """Keep rows with at least ``min_tokens`` tokens; ``out`` (when given)
    receives the full token count."""
    kept = df.filter(has_min_tokens(col, min_tokens, tokenizer))
    return kept.withColumn(out, token_count(col, tokenizer)) if out else kept


def truncate_tokens(col, max_tokens: int = MAX_TOKENS,
                    tokenizer: Tokenizer = whitespace_tokenizer) -> Column:
    """First ``max_tokens`` tokens, decoded (joined) and stripped.  With the
    whitespace tokenizer only the leading tokens are scanned."""
    c = F.col(col) if isinstance(col, str) else col
    if tokenizer is whitespace_tokenizer:
        return T.leading_words(c, max_tokens)
    return T.strip_ws(F.array_join(F.slice(tokenizer(c), 1, max_tokens), " "))


def has_min_tokens(col, min_tokens: int = MIN_TOKENS,
                   tokenizer: Tokenizer = whitespace_tokenizer) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    if tokenizer is whitespace_tokenizer:
        return T.has_min_words(c, min_tokens)
    return F.size(tokenizer(c)) >= min_tokens


def min_word_filter(df: DataFrame, col: str, min_words: int = MIN_WORDS,
                    out: str = "n_words") -> DataFrame:
    """Drop rows with fewer than ``min_words`` whitespace words."""
    return df.withColumn(out, T.word_count(col)).filter(F.col(out) >= min_words)


def extract_marker(col, marker: str = MARKER) -> Column:
    """Text after the last marker, whitespace- then quote-stripped; null
    when the marker is absent (the row is then dropped)."""
    c = F.col(col) if isinstance(col, str) else col
    got = T.strip_chars(T.strip_ws(T.after_last(c, marker)), '"')
    return F.when(c.contains(marker), got)


def extract_enhanced(df: DataFrame, col: str = "response", out: str = "enhanced_prompt",
                     marker: str = MARKER) -> DataFrame:
    return df.withColumn(out, extract_marker(col, marker)).filter(F.col(out).isNotNull())


def project_with_defaults(df: DataFrame, columns: Sequence[str], default: str = "") -> DataFrame:
    """``row.get(col, default)`` for a fixed output header: a column the
    input lacks becomes the default literal."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(default).alias(c) for c in columns])


def drop_failed(df: DataFrame, col: str) -> DataFrame:
    return df.filter(F.col(col).isNotNull())


def run_summary(df: DataFrame, ok: Column) -> DataFrame:
    """Intended vs succeeded counts in one aggregate."""
    return df.agg(F.count(F.lit(1)).alias("intended"),
                  F.count_if(ok).cast("bigint").alias("succeeded"))


def observed_summary(df: DataFrame, ok: Column, write: Callable[[DataFrame], None]) -> dict:
    """``write`` the rows that are ``ok`` and return the counts of
    ``run_summary``, taken from the rows on their way: no second read."""
    seen = Observation()
    counted = df.withColumn("_ok", F.coalesce(ok, F.lit(False))).observe(
        seen, F.count(F.lit(1)).alias("intended"), F.count_if("_ok").cast("bigint").alias("succeeded"))
    write(counted.filter("_ok").drop("_ok"))
    return seen.get
