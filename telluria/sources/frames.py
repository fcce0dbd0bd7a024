"""Binary device frames (survey S16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def int24(frame: str, start: int) -> Column:
    """Signed big-endian three-byte number at a 1-based byte position."""
    raw = F.conv(F.hex(F.substring(frame, start, 3)), 16, 10).cast("int")
    return F.when(raw >= 1 << 23, raw - F.lit(1 << 24)).otherwise(raw)


def decode_frames(df: DataFrame, frame: str = "frame") -> DataFrame:
    """Nine bytes to x, y, z; frames of another length give NULL."""
    whole = F.octet_length(frame) == 9
    return df.withColumns({axis: F.when(whole, int24(frame, 1 + 3 * i)) for i, axis in enumerate("xyz")})


def encode_int24(value: Column) -> Column:
    """Inverse of :func:`int24`, for fixtures and device simulators."""
    return F.unhex(F.lpad(F.hex(F.pmod(value.cast("long"), F.lit(1 << 24))), 6, "0"))
