"""Dataset registry: names with an optional ``%NN`` sampling suffix map to
registered annotation readers; the selected datasets are unioned."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RATE_SUFFIX = r"%(\d+)$"


def rate_of(spec) -> Column:
    """``name%25`` -> 0.25; no suffix -> 1.0."""
    c = F.col(spec) if isinstance(spec, str) else spec
    digits = F.regexp_extract(c, RATE_SUFFIX, 1)
    return F.when(digits == "", F.lit(1.0)).otherwise(digits.cast("bigint") / F.lit(100.0))


def strip_rate(spec) -> Column:
    c = F.col(spec) if isinstance(spec, str) else spec
    return F.regexp_replace(c, RATE_SUFFIX, "")


def parse_spec(spec: str) -> tuple[str, float]:
    """Driver-side parse of one configured name (configuration, not data)."""
    import re
    m = re.search(RATE_SUFFIX, spec)
    return (re.sub(RATE_SUFFIX, "", spec), int(m.group(1)) / 100.0 if m else 1.0)


@dataclass(frozen=True)
class Dataset:
    """A registered dataset: how to read its annotations and where its
    media live."""
    name: str
    reader: Callable[[SparkSession], DataFrame]
    data_path: str = ""


class Registry:
    def __init__(self, datasets: Sequence[Dataset] = ()):
        self._d = {d.name: d for d in datasets}

    def register(self, d: Dataset) -> "Registry":
        self._d[d.name] = d
        return self

    def load(self, spark: SparkSession, specs: Sequence[str], id_col: str = "id",
             seed: int = 0) -> DataFrame:
        """Union of the named datasets, each exact-sampled at its rate,
        tagged with ``dataset``, ``data_path`` and ``sampling_rate``.
        Unknown names raise, as the reference does."""
        from ..operators.select import sample_by_threshold
        frames = []
        for spec in specs:
            name, rate = parse_spec(spec)
            if name not in self._d:
                raise ValueError(f"do not find {name}")
            ds = self._d[name]
            df = ds.reader(spark)
            if rate < 1.0:
                df = sample_by_threshold(df, id_col, rate, seed=seed)
            frames.append(df.withColumn("dataset", F.lit(name))
                          .withColumn("data_path", F.lit(ds.data_path))
                          .withColumn("sampling_rate", F.lit(rate)))
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f, allowMissingColumns=True)
        return out
