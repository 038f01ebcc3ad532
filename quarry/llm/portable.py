"""Hash expressions in plain 64-bit arithmetic, the same in Spark and in any SQL engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

P = 2**31 - 1


def hash31(x: Column, seed: int) -> Column:
    """A well mixed value in 0 .. 2^31-2 of a long, null as 0; no product leaves 62 bits."""
    t = F.pmod(F.coalesce(x, F.lit(0)).cast("long"), F.lit(P))
    for k in range(3):
        t = (t * F.lit(1103515245 - 2 * k) + F.lit(seed * 7919 + 12345 + k)) % F.lit(P)
        t = (t * t + t * F.lit(69069) + F.lit(seed + 1)) % F.lit(P)
    return t


def hash31_sql(x: str, seed: int) -> str:
    """hash31 as DuckDB SQL."""
    t = f"(((coalesce({x}, 0)::HUGEINT % {P}) + {P}) % {P})"
    for k in range(3):
        t = f"(({t} * {1103515245 - 2 * k} + {seed * 7919 + 12345 + k}) % {P})"
        t = f"list_transform([{t}], lambda v: (v * v + v * 69069 + {seed + 1}) % {P})[1]"
    return t
