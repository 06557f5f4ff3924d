"""Unions of samples and of like sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def union_samples(*frames: DataFrame) -> DataFrame:
    """All samples of all extraction jobs; columns a frame lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_sources(*frames: DataFrame) -> DataFrame:
    """Like sources (IPv4 and IPv6 socket tables) as one; same columns required."""
    return reduce(lambda a, b: a.unionByName(b), frames)
