"""Reproducible draws that every engine with MD5 repeats exactly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hashed(seed: int, *parts: Column) -> Column:
    """A 32-bit number from the seed and the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def draw(seed: int, range_id: Column, boot_id: Column, slot: Column, n: Column) -> Column:
    """The 0-based position that a slot of a resample takes."""
    return hashed(seed, range_id, boot_id, slot) % n


def sql_draw(seed: int, range_id: str, boot_id: str, slot: str, n: str) -> str:
    return f"('0x' || substr(md5(concat_ws(':', '{seed}', {range_id}, {boot_id}, {slot})), 1, 8))::BIGINT % {n}"
