"""Vector Column helpers over ARRAY<FLOAT|DOUBLE>; arithmetic in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(col) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.transform(c, lambda x: x.cast("double"))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(F.transform(_d(a), lambda x: x * x), F.lit(0.0), lambda acc, x: acc + x))


def cosine(a, b, eps: float = 1e-8) -> Column:
    """``torch.cosine_similarity`` (norms clamped below by eps)."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(eps)) * F.greatest(norm(b), F.lit(eps)))


# Row scalars (max, sum, norm) are passed through aggregate()'s finish
# lambda so they are computed once per row, not once per element.

def l2_normalize(a, eps: float = 1e-12) -> Column:
    """Unit vectors; the norm is clamped below by eps, so a zero vector
    stays zero."""
    v = _d(a)
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x,
                       lambda s: F.transform(v, lambda x: x / F.greatest(F.sqrt(s), F.lit(eps))))


def softmax(a, scale: float = 1.0) -> Column:
    """Row softmax of ``scale * a`` with max subtraction."""
    v = F.transform(_d(a), lambda x: x * F.lit(scale))
    e = F.aggregate(v, F.lit(float("-inf")), lambda m, x: F.greatest(m, x),
                    lambda m: F.transform(v, lambda x: F.exp(x - m)))
    return F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x,
                       lambda s: F.transform(e, lambda x: x / s))


def plogp_sum(p, eps: float) -> Column:
    """sum_k p_k * ln(p_k + eps)."""
    return F.aggregate(F.transform(p, lambda x: x * F.ln(x + F.lit(eps))), F.lit(0.0), lambda acc, x: acc + x)
