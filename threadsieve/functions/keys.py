"""Reproducible keys: bucketable orders and seeded pseudo-random numbers.

Ranks over a whole class cannot be computed by one task, so every global order
used here is exposed as a list of *levels*: integer or short-string columns
whose lexicographic order equals the wanted order and which each take a bounded
number of values. Ties are broken by the MD5 of the row id, which spreads rows
evenly whatever the ids look like.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(row_id: Column, seed: int | None = None) -> Column:
    text = row_id.cast("string")
    if seed is not None:
        text = F.concat(F.lit(f"{seed}:"), text)
    return F.md5(text)


def seeded_long(key: Column, seed: int) -> Column:
    """Uniform 60-bit integer for a key and a seed."""
    return F.conv(F.substring(digest(key, seed), 1, 15), 16, 10).cast("long")


def seeded_unit(key: Column, seed: int) -> Column:
    """Uniform number in [0, 1) for a key and a seed."""
    return seeded_long(key, seed).cast("double") / F.lit(float(1 << 60))


def time_levels_desc(time: Column) -> list[Column]:
    """Newest first: day, second of the day, microsecond of the second."""
    return [
        -F.unix_date(F.to_date(time)),
        -(F.hour(time) * 3600 + F.minute(time) * 60 + F.second(time)),
        -F.date_format(time, "SSSSSS").cast("int"),
    ]


def time_levels_asc(time: Column) -> list[Column]:
    return [-c for c in time_levels_desc(time)]


def score_levels_desc(score: Column) -> list[Column]:
    """Highest score first: two 16-bit digits of a score in [0, 1], then the score."""
    high = F.floor(score * 65536)
    low = F.floor((score * 65536 - high) * 65536)
    return [-high, -low, -score]


def digest_level(digest_col: Column) -> Column:
    """First 16 bits of a digest: 65,536 even buckets."""
    return F.substring(digest_col, 1, 4)
