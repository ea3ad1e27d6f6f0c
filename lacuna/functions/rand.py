"""Draws that any engine with md5 repeats: a uniform or normal number for a cell, a seed and a tag."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def uniform(*parts, seed: int | Column, tag: str) -> Column:
    """In (0, 1), from the first 52 bits of a hash of the parts, the seed and the tag."""
    text = F.concat_ws("|", *[_col(p).cast("string") for p in parts], _col(seed).cast("string"), F.lit(tag))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(2**52))


def normal(*parts, seed: int | Column, tag: str) -> Column:
    """Standard normal, by Box and Muller."""
    u1, u2 = uniform(*parts, seed=seed, tag=tag + "1"), uniform(*parts, seed=seed, tag=tag + "2")
    return F.sqrt(-2 * F.ln(u1)) * F.cos(F.lit(2 * math.pi) * u2)


def student_t(*parts, seed: int | Column, tag: str, df: float) -> Column:
    """Student's t in Bailey's polar form, which needs two uniforms."""
    u1, u2 = uniform(*parts, seed=seed, tag=tag + "1"), uniform(*parts, seed=seed, tag=tag + "2")
    return F.sqrt(F.lit(float(df)) * (F.pow(u1, F.lit(-2.0 / df)) - 1)) * F.cos(F.lit(2 * math.pi) * u2)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
