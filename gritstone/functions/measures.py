"""Column functions over measured times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def improvement_column(baseline: Column, candidate: Column) -> Column:
    """Signed improvement in percent; 0 where the baseline is not positive."""
    return F.when(baseline > 0, (baseline - candidate) / baseline * 100).otherwise(F.lit(0.0))


def reward_column(baseline: Column, candidate: Column) -> Column:
    """The relative gain; a regression earns nothing."""
    return F.when(baseline > 0, F.greatest(F.lit(0.0), (baseline - candidate) / baseline)).otherwise(F.lit(0.0))
