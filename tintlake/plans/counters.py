"""Counts of a run that come from the write itself, not from reading its rows again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..schemas import STATUSES


def counted(results: DataFrame) -> tuple[DataFrame, Callable[[], dict[str, int]]]:
    """Results that count their rows by status while the next action on them runs; the counts, once it has."""
    seen = Observation()
    observed = results.observe(seen, *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])
    return observed, lambda: {s: n for s, n in seen.get.items() if n}
