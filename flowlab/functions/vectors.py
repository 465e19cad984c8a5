"""Array-valued expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import quoted


def assemble(cols: list[str], dtype: str = "double") -> Column:
    """Feature columns of a row as one array."""
    return F.array(*[quoted(c).cast(dtype) for c in cols])


def l2_norm(vec: Column) -> Column:
    """Euclidean length of an array column."""
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def clip_l2(vec: Column, limit: float) -> Column:
    """Scale an array down to length ``limit`` when it is longer."""
    factor = F.least(F.lit(1.0), F.try_divide(F.lit(float(limit)), l2_norm(vec)))
    scale = F.coalesce(factor, F.lit(1.0))
    return F.transform(vec, lambda x: x.cast("double") * scale)
