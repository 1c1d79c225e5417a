"""Array literals and lookups that stay inside one expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def long_array(values: Sequence[int]) -> Column:
    """A constant array<bigint>; one literal in the plan however many values it has."""
    if not len(values):
        return F.array().cast("array<bigint>")
    return F.split(F.lit(",".join(str(int(v)) for v in values)), ",").cast("array<bigint>")


def bucket_of(value: Column, bounds: Sequence[int]) -> Column:
    """How many of the ascending ``bounds`` are <= ``value`` (int), by binary search."""
    if not len(bounds):
        return F.lit(0)
    bits = len(bounds).bit_length()
    padded = [*bounds, *[2**63 - 1] * (2**bits - 1 - len(bounds))]
    steps = F.array(*[F.lit(2**i) for i in range(bits - 1, -1, -1)])
    found = F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when(F.element_at(long_array(padded), at + step) <= value, at + step).otherwise(at),
    )
    return F.least(found, F.lit(len(bounds)))
