"""Keyed random draws.

A draw is a deterministic expression of ``(seed, setting, stage, row id, lane)``. Rows have
no position in Spark, so tying a draw to the row id is what makes a mask independent of
partitioning, safe under task retries and repeatable in another engine.

``sha256`` is for tables that are released: with a secret seed nobody can recompute the
noise. ``xxhash64`` costs a few nanoseconds instead of a microsecond and is for trials, such
as a sweep over settings, whose masked rows never leave the cluster.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from fractions import Fraction
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANES = 4
HEX_DIGITS = 13
RESOLUTION = float(2**52)


def key_number(text: str) -> int:
    """Non-negative 60-bit number of a text."""
    return int(hashlib.sha256(text.encode()).hexdigest()[:15], 16)


@dataclass(frozen=True)
class Draws:
    """Source of uniform draws in the open interval (0, 1)."""

    seed: str | int = 42
    kind: str = "sha256"

    def __post_init__(self) -> None:
        if self.kind not in ("sha256", "xxhash64"):
            raise ValueError(f"unknown draw kind: {self.kind}")

    def key_column(self, key: str | Column) -> Column:
        """What identifies a setting: a text for sha256, its number for xxhash64."""
        if isinstance(key, Column):
            return key
        return F.lit(key) if self.kind == "sha256" else F.lit(key_number(key)).cast("bigint")

    def _token(self, key: str | Column, stage: str, row_id: Column) -> Column:
        parts = (F.lit(str(self.seed)), self.key_column(key), F.lit(stage), row_id.cast("string"))
        return F.sha2(F.concat_ws(":", *parts), 256)

    def _read(self, token: Column, lane: int) -> Column:
        digits = F.substring(token, 1 + HEX_DIGITS * lane, HEX_DIGITS)
        return self._share(F.conv(digits, 16, 10).cast("bigint"))

    def _share(self, bits: Column) -> Column:
        return (bits.cast("double") + F.lit(0.5)) / F.lit(RESOLUTION)

    def _hashed(self, key: str | Column, stage: str, row_id: Column, lane: int) -> Column:
        place = F.lit(key_number(f"{self.seed}:{stage}:{lane}")).cast("bigint")
        return self._share(F.shiftrightunsigned(F.xxhash64(place, self.key_column(key), row_id), 12))

    def uniform(self, key: str | Column, stage: str, row_id: Column, lane: int = 0) -> Column:
        """One draw per row."""
        if not 0 <= lane < LANES:
            raise ValueError(f"lane must be in 0..{LANES - 1}")
        if self.kind == "sha256":
            return self._read(self._token(key, stage, row_id), lane)
        return self._hashed(key, stage, row_id, lane)

    def below(self, key: str | Column, stage: str, row_id: Column, share: float) -> Column:
        """Whether ``uniform`` is below ``share``; sha256 compares the digits as they are."""
        if self.kind != "sha256":
            return self.uniform(key, stage, row_id) < F.lit(share)
        first = ceil(Fraction(share) * 2**52 - Fraction(1, 2))  # the least number whose draw is not below
        if not 0 < first < 2**52:
            return F.lit(first > 0)
        return F.substring(self._token(key, stage, row_id), 1, HEX_DIGITS) < F.lit(f"{first:0{HEX_DIGITS}x}")

    def add(self, df: DataFrame, key: str | Column, stage: str, row_id: Column) -> DataFrame:
        """Four draws per row as ``__u0..__u3``; sha256 reads all of them from one hash."""
        if self.kind == "xxhash64":
            return df.withColumns({f"__u{i}": self._hashed(key, stage, row_id, i) for i in range(LANES)})
        hashed = df.withColumn("__token", self._token(key, stage, row_id))
        return hashed.withColumns({f"__u{i}": self._read(F.col("__token"), i) for i in range(LANES)}).drop("__token")


TRIAL = Draws(kind="xxhash64")


def gaussian_pair(u1: Column, u2: Column) -> tuple[Column, Column]:
    """Two independent standard normal values from two uniforms (Box-Muller)."""
    radius = F.sqrt(F.lit(-2.0) * F.log(u1))
    angle = F.lit(2.0) * F.pi() * u2
    return radius * F.cos(angle), radius * F.sin(angle)


def laplace(u: Column, scale: Column) -> Column:
    """Laplace value by inverse distribution function."""
    centred = u - F.lit(0.5)
    return -scale * F.signum(centred) * F.log(F.lit(1.0) - F.lit(2.0) * F.abs(centred))
