"""Hash-based sampling that does not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: number of distinct 8-digit hexadecimal prefixes.
HASH_RANGE = 4294967296


def hash_fraction(key: Column, seed: int = 42) -> Column:
    """Number in [0, 1) that depends only on ``seed`` and the key's text."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(HASH_RANGE)
