"""Integer vectors from columns of floating-point components."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_finite(embedding: str) -> Column:
    """Whether a vector is there and has no null or non-finite component."""
    return F.coalesce(F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def scaled(embedding: str, scale: int) -> Column:
    """``floor(scale * x)`` of every component; beyond a long, the nearest long."""
    return F.transform(embedding, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))
