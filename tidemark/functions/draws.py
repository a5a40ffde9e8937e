"""Randomness defined by identifiers: the same id and seed give the same draw in any partitioning."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 4294967296.0


def tag(*parts) -> Column:
    """Join the parts of a draw's identity with ``|``."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws("|", *[c.cast("string") for c in cols])


def digest(*parts) -> Column:
    return F.md5(tag(*parts).cast("binary"))


def crc_seed(*parts) -> Column:
    """CRC-32 of the joined parts: a short stable seed of a named task."""
    return F.crc32(tag(*parts).cast("binary"))


def hash32(*parts) -> Column:
    """First eight hex digits of the md5 as an integer."""
    return F.conv(F.substring(digest(*parts), 1, 8), 16, 10).cast("bigint")


def uniform(*parts) -> Column:
    """Uniform on [0, 1) from the md5 of the parts."""
    return hash32(*parts) / F.lit(TWO32)


def poisson_bounds() -> list[str]:
    """Upper bounds of 32-bit draws, as eight hex digits, for the values 0, 1, 2, … of a Poisson count of mean 1."""
    bounds, share, k = [], math.exp(-1), 0
    total = share
    while total * TWO32 < TWO32 - 1:
        bounds.append(f"{math.floor(total * TWO32):08x}")
        k += 1
        share /= k
        total += share
    return bounds
