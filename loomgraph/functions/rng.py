"""Counter-based random numbers: a hash of the draw's coordinates, the same in Spark, in SQL and in NumPy.

A draw depends on nothing but its coordinates, so results don't change with partitioning, retries or the order of rows.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 42
_SPAN = 2.0**52


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def key(tag: str, *ids, seed: int = SEED) -> Column:
    """32 hex digits; sorting by them is a random order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(tag), *[_col(i).cast("string") for i in ids]))


def key_bound(count: Column, of: Column) -> Column:
    """Digits below which ``count`` of ``of`` keys lie, but for less than one time in millions, and few more."""
    most = F.ceil((count + 8 * F.sqrt(count) + 16) / of * F.lit(2.0**32))
    return F.when(most < 2**32, F.lpad(F.lower(F.hex(most)), 8, "0")).otherwise("g")


def u01(tag: str, *ids, seed: int = SEED) -> Column:
    """Uniform in [0, 1)."""
    return F.conv(F.substring(key(tag, *ids, seed=seed), 1, 13), 16, 10).cast("double") / F.lit(_SPAN)


def below(m, tag: str, *ids, seed: int = SEED) -> Column:
    """Uniform integer in [0, m)."""
    m = _col(m)
    return F.least(F.floor(u01(tag, *ids, seed=seed) * m), m - 1).cast("long")


def normal(tag: str, *ids, seed: int = SEED) -> Column:
    """Standard normal, from two uniform draws."""
    r = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u01(tag, *ids, "r", seed=seed)))
    return r * F.cos(F.lit(2 * math.pi) * u01(tag, *ids, "a", seed=seed))


def key_sql(tag: str, *ids: str, seed: int = SEED) -> str:
    return f"md5(concat_ws('|', '{seed}', '{tag}'{''.join(f', ({i})::VARCHAR' for i in ids)}))"


def u01_sql(tag: str, *ids: str, seed: int = SEED) -> str:
    """The same draw in DuckDB."""
    return f"(('0x' || substr({key_sql(tag, *ids, seed=seed)}, 1, 13))::BIGINT::DOUBLE / 4503599627370496.0)"


def below_sql(m: str, tag: str, *ids: str, seed: int = SEED) -> str:
    return f"least(floor({u01_sql(tag, *ids, seed=seed)} * ({m})), ({m}) - 1)::BIGINT"


def normal_sql(tag: str, *ids: str, seed: int = SEED) -> str:
    r, a = (u01_sql(tag, *ids, f"'{x}'", seed=seed) for x in "ra")
    return f"(sqrt(-2.0 * ln(1.0 - {r})) * cos({2 * math.pi!r} * {a}))"


def u01_py(tag: str, *ids, seed: int = SEED) -> float:
    """The same draw in Python, for block execution."""
    s = "|".join([str(seed), tag, *map(str, ids)])
    return int(hashlib.md5(s.encode()).hexdigest()[:13], 16) / _SPAN


def below_py(m: int, tag: str, *ids, seed: int = SEED) -> int:
    return min(int(u01_py(tag, *ids, seed=seed) * m), m - 1)
