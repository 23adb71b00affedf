"""Random draws as a function of the row, not of where the row sits.

``rand(seed)`` depends on partition numbering, so a re-run or a lost executor changes its values.
Hashing the row's key gives the same draw under any partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(keys: Sequence[Column], seed: int, salt: str) -> Column:
    """U[0, 1) from the first 32 bits of an MD5 over seed, salt and key columns."""
    text = F.concat_ws("#", F.lit(str(seed)), F.lit(salt), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def standard_normal(keys: Sequence[Column], seed: int, salt: str) -> Column:
    """N(0, 1) by Box-Muller; ``1 - u`` keeps the logarithm away from zero."""
    radius = F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - uniform(keys, seed, salt + "-r")))
    return radius * F.cos(F.lit(2.0 * math.pi) * uniform(keys, seed, salt + "-a"))
