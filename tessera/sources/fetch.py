"""Remote media fetch as a ledger job.

Urls are spread over tasks (``repartition``) and fetched inside
``mapInPandas`` by a fetcher built once per task; each url yields one
ledger row (key, url, status, attempts, bytes_len, error, body).  Up to 3
retries, with exponential backoff, on 500/502/503/504 and on connection
errors; any other non-200 status is final.
Task retries by Spark re-run the whole partition, so the ledger stays
complete when an executor is lost.
"""

from __future__ import annotations

import time
from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.bloom import without_partner

# ---- fixed values: retry policy -------------------------
RETRY_STATUSES = (500, 502, 503, 504)
MAX_RETRIES = 3
BACKOFF_FACTOR = 0.5
TIMEOUT_S = 2.5

LEDGER_SCHEMA = "key bigint, url string, status int, attempts int, bytes_len bigint, error string, body binary"

# A fetcher maps (url, row) -> (status, body bytes or None).
Fetcher = Callable[[str, dict], tuple]


def http_fetcher(timeout: float = TIMEOUT_S) -> Fetcher:
    """Plain HTTP GET via the standard library."""
    import urllib.error
    import urllib.request

    def fetch(url: str, row: dict):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as r:
                return r.status, r.read()
        except urllib.error.HTTPError as e:
            return e.code, None
    return fetch


def fetch_with_retry(fetch: Fetcher, url: str, row: dict, retries: int = MAX_RETRIES,
                     backoff: float = BACKOFF_FACTOR, sleep=time.sleep):
    attempts = 0
    while True:
        attempts += 1
        try:
            status, body = fetch(url, row)
        except Exception as e:  # a connection error or a timeout
            if attempts <= retries:
                if backoff > 0:
                    sleep(backoff * (2 ** (attempts - 1)))
                continue
            return None, attempts, None, f"{type(e).__name__}: {e}"
        if status == 200:
            return status, attempts, body or b"", None
        if status in RETRY_STATUSES and attempts <= retries:
            if backoff > 0:
                sleep(backoff * (2 ** (attempts - 1)))
            continue
        return status, attempts, None, f"HTTP {status}"


def fetch_ledger(df: DataFrame, key: str, url: str, make_fetcher: Callable[[], Fetcher],
                 extra: tuple = (), partitions: int | None = None, retries: int = MAX_RETRIES,
                 backoff: float = BACKOFF_FACTOR) -> DataFrame:
    """One ledger row per url; ``extra`` columns are handed to the fetcher."""
    src = df.select(F.col(key).cast("bigint").alias("key"), F.col(url).alias("url"), *extra)
    if partitions:
        src = src.repartition(partitions, "key")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fetch = make_fetcher()
        for pdf in it:
            out = []
            for row in pdf.to_dict("records"):
                st, n, body, err = fetch_with_retry(fetch, row["url"], row, retries, backoff)
                out.append((row["key"], row["url"], st, n, None if body is None else len(body), err, body))
            yield pd.DataFrame(out, columns=["key", "url", "status", "attempts", "bytes_len", "error", "body"]).astype(
                {"status": "Int32", "attempts": "int32", "bytes_len": "Int64"})

    return src.mapInPandas(run, LEDGER_SCHEMA)


def fetch_todo(urls: DataFrame, done: DataFrame, key: str, by_filter: bool = False) -> DataFrame:
    """Skip what is already present: anti join on the key (AQE broadcasts
    the cache listing when it is small, sort-merges it otherwise).  With
    ``by_filter`` only rows that a Bloom filter of the cache has are joined
    with it: for a large table of which little is in the cache."""
    if by_filter:
        return without_partner(urls, done, key, key)
    return urls.join(done.select(key).distinct(), key, "left_anti")
