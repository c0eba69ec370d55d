"""Vector column expressions (JVM side, whole-stage codegen friendly).

All arithmetic is in DOUBLE with a fixed left-to-right summation order, so scores do not
depend on partitioning or BLAS blocking and equal a sequential sum in any other engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double_array(v) -> Column:
    return F.transform(_col(v), lambda x: x.cast("double"))


def dot(a, b) -> Column:
    """Sequential dot product of two equal-length numeric arrays, in DOUBLE."""
    prods = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, p: acc + p)


def sum_squares(v) -> Column:
    return F.aggregate(F.transform(_col(v), lambda x: x.cast("double") * x.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, p: acc + p)


def l2_norm(v) -> Column:
    return F.sqrt(sum_squares(v))


def cosine(a, b, norm_a=None, norm_b=None) -> Column:
    """dot / (|a| * |b|); a zero vector scores 0 (never NULL, never an error)."""
    na = _col(norm_a) if norm_a is not None else l2_norm(a)
    nb = _col(norm_b) if norm_b is not None else l2_norm(b)
    return F.coalesce(F.try_divide(dot(a, b), na * nb), F.lit(0.0))


def l2_normalize(v, norm=None) -> Column:
    """x / |x| element-wise in DOUBLE; a zero vector stays zero."""
    n = _col(norm) if norm is not None else l2_norm(v)
    return F.transform(_col(v), lambda x: F.coalesce(F.try_divide(x.cast("double"), n), F.lit(0.0)))


def is_valid_vector(v, dim: int) -> Column:
    """Right length, no NULL element, no NaN/Inf element."""
    bad = F.exists(_col(v), lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return _col(v).isNotNull() & (F.size(_col(v)) == dim) & ~bad
