"""Uniform draws that depend on a seed and keys only, so that results don't depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, stage: str, *keys: Column | str) -> Column:
    """A number in [0, 1) with 52 bits, from the md5 of seed, stage and keys."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.lit(stage), *keys))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(4503599627370496.0)
