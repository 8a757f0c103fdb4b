"""Splits and samples by threshold: the k-th key of a total order without a
sort.

"The first 80 %" of a ranking, or an exact sample, needs one key - the last
that still belongs - and not the place of every row.  ``kth_key`` finds it in a
few passes over the order columns alone: a quantile sketch of the keys between
two bounds proposes two new bounds around the wanted rank, the next pass counts
exactly what lies below, at, between and above them, and goes on where the rank
falls; with two hundred quantiles each pass keeps about a hundredth.  When
few enough keys are left, they are read.  Nothing is moved but sketches
and counts, however many rows are equal: equal rows of one column are told apart
by the next one.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import _order_value, seeded_key

QUANTILES, ACCURACY, FEW = 200, 2_000, 10_000
_PIECE = 6               # bytes of a text key that make one number


def _ascending(df: DataFrame, order_by: Sequence) -> list[Column]:
    """The order as columns of numbers, smallest first.  A null flag goes
    before a column that may be null; a text is cut into numbers of its bytes
    (as many as the longest has, 32 at most: a key longer than that is refused)."""
    out = []
    for c in order_by:
        value = _order_value(c)
        how = "asc" if isinstance(c, str) else c[1]
        kind = df.select(value.alias("x")).schema[0].dataType.typeName()
        first = how.endswith("nulls_first") or how == "asc"
        out.append(F.when(value.isNull(), 0 if first else 1).otherwise(1 if first else 0))
        if kind == "string":
            longest = df.agg(F.coalesce(F.max(F.octet_length(value)), F.lit(0))).first()[0]
            if longest > 32 * _PIECE:
                raise ValueError(f"text keys of at most {32 * _PIECE} bytes")
            raw = F.hex(F.encode(value, "UTF-8"))
            pieces = [F.conv(F.rpad(F.substring(raw, 1 + 2 * _PIECE * i, 2 * _PIECE), 2 * _PIECE, "0"), 16, 10).cast("bigint")
                      for i in range(-(-longest // _PIECE))]
            pieces.append(F.octet_length(value).cast("bigint"))          # a text before those it begins
            out += [-p for p in pieces] if how.startswith("desc") else pieces
        elif kind in ("byte", "short", "integer", "long", "float", "double"):
            out.append(-value if how.startswith("desc") else value)
        else:
            raise ValueError(f"no threshold over {kind}")
    return out


def kth_key(df: DataFrame, keys: Sequence[Column], k: int) -> tuple[list, int]:
    """(values, rank): the values of ``keys`` (ascending numbers) of the row
    with the 0-based place ``k`` in their order, and its place among the rows
    that agree in all of them."""
    names = [f"_k{i}" for i in range(len(keys))]
    rest, values = df.select(*[c.alias(n) for n, c in zip(names, keys)]), []
    while names:
        # one pass: how many, and which leading columns have one value only (a null flag, mostly)
        seen = rest.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{f.__name__}{c}") for c in names for f in (F.min, F.max, F.count)]).first()
        if seen["n"] <= FEW:
            rows = rest.select(*names).orderBy(*names).collect()
            found = tuple(rows[k])
            return values + list(found), k - [tuple(r) for r in rows].index(found)
        name = names.pop(0)
        value = seen[f"min{name}"]
        if value != seen[f"max{name}"] or seen[f"count{name}"] not in (0, seen["n"]):
            value, k = _kth_value(rest.select(name), F.col(name), k)
            rest = rest.filter(F.col(name).isNull() if value is None else F.col(name) == F.lit(value))
        values.append(value)
    return values, k


def _kth_value(df: DataFrame, key: Column, k: int):
    """The value at place ``k`` and the place among its equals; nulls are
    told apart by a flag before, so a null key is one value."""
    cuts = F.percentile_approx
    low = high = None                   # what is looked at lies between, without them
    proposal = None
    while True:
        x = df
        if low is not None:
            x = x.filter(key > F.lit(low))
        if high is not None:
            x = x.filter(key < F.lit(high))
        if proposal is None:            # quantiles of all that is left
            n, found = x.agg(F.count(F.lit(1)), cuts(key, [i / QUANTILES for i in range(QUANTILES + 1)], ACCURACY)).first()
            if found is None:           # nothing but nulls
                return None, k
            if n <= FEW:
                return _among_few(x, key, k)
            proposal = _bounds(found, k / n)
        a, b = proposal
        below, at_a, between, at_b, found = x.agg(
            F.count_if(key < F.lit(a)), F.count_if(key == F.lit(a)), F.count_if((key > F.lit(a)) & (key < F.lit(b))),
            F.count_if(key == F.lit(b)) if b > a else F.lit(0),
            cuts(F.when((key > F.lit(a)) & (key < F.lit(b)), key), [i / QUANTILES for i in range(QUANTILES + 1)], ACCURACY)).first()
        proposal = None
        if k < below:
            high = a
        elif k < below + at_a:
            return a, k - below
        elif k < below + at_a + between:
            low, high, k = a, b, k - below - at_a
            if between <= FEW:
                return _among_few(df.filter((key > F.lit(low)) & (key < F.lit(high))), key, k)
            proposal = _bounds(found, k / between)
        elif k < below + at_a + between + at_b:
            return b, k - below - at_a - between
        else:
            low, k = b, k - below - at_a - between - at_b


def _bounds(found: list, share: float) -> tuple:
    """Two quantiles around ``share``, far enough apart for the error of the sketch."""
    at = min(max(share, 0.0), 1.0) * QUANTILES
    return found[max(0, math.floor(at) - 1)], found[min(QUANTILES, math.ceil(at) + 1)]


def _among_few(x: DataFrame, key: Column, k: int):
    for value, n in x.groupBy(key.alias("v")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("v").asc_nulls_last()).collect():   # <= FEW
        if k < n:
            return value, k
        k -= n
    raise ValueError("fewer rows than the place asked for")


def first_rows(df: DataFrame, order_by: Sequence, n: int) -> Column:
    """Whether a row is among the first ``n`` of the order, whose last column
    is unique."""
    if n <= 0:
        return F.lit(False)
    keys = _ascending(df, order_by)
    values, _ = kth_key(df, keys, n - 1)
    out = F.lit(True)
    for key, value in zip(reversed(keys), reversed(values)):
        same = key.isNull() if value is None else key.eqNullSafe(F.lit(value))
        out = (F.lit(False) if value is None else F.coalesce(key < F.lit(value), F.lit(False))) | (same & out)
    return out


def split_by_threshold(df: DataFrame, order_by: Sequence, ratio: float = 0.8, name: str = "split") -> DataFrame:
    """First ``int(n * ratio)`` rows in order are train, the rest test: what
    ``rows.ratio_split`` gives, without the place of each row."""
    n = df.count()
    cut = math.floor(n * float(ratio))
    train = F.lit(True) if cut >= n else first_rows(df, order_by, cut)
    return df.withColumn(name, F.when(train, "train").otherwise("test"))


def sample_by_threshold(df: DataFrame, id_col: str, rate: float, seed: int = 0) -> DataFrame:
    """The rows that ``rows.sample_exact`` draws (the same seeded order),
    without their places."""
    if rate >= 1.0:
        return df
    n = df.count()
    return df.filter(first_rows(df, [(seeded_key(id_col, seed), "asc"), id_col], math.floor(n * float(rate))))
