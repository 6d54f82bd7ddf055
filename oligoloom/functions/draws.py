"""Reproducible random numbers from digests, which other engines can follow."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGEST_BITS = 60


def digest_number(*parts: Column | int) -> Column:
    """A 60-bit number from the MD5 digest of the parts, joined by hyphens."""
    text = F.concat_ws("-", *[F.lit(str(p)) if isinstance(p, int) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")
