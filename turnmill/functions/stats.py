"""Interval estimates as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from turnmill import constants as K


def wilson(successes: Column, total: Column, z: float = K.WILSON_Z) -> tuple[Column, Column]:
    """Lower and upper Wilson bound; null for an empty sample, exactly 0 or 1 at the edges."""
    n, k = F.when(total > 0, total.cast("double")), successes.cast("double")
    center = (k + z * z / 2) / (n + z * z)
    radius = z * F.sqrt(k * (n - k) / n + z * z / 4) / (n + z * z)
    low = F.when(n.isNull(), None).when(k == 0, 0.0).otherwise(F.greatest(F.lit(0.0), center - radius))
    high = F.when(n.isNull(), None).when(k == n, 1.0).otherwise(F.least(F.lit(1.0), center + radius))
    return low, high
