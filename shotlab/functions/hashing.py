"""Portable random keys.

Every random choice in the library is a pure function of
``md5(seed|salt|key...)``, so a draw does not depend on partitioning, task
order or retries, and the same draw can be written in plain SQL
(``md5(concat_ws('|', ...))`` exists in Spark and DuckDB alike).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HEX = 15                    # 60 bits: fits a signed BIGINT
_SCALE = float(16 ** _HEX)


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def hkey(seed: int, salt: str, *cols) -> Column:
    """Hex md5 of ``seed|salt|c1|c2...``; ordering by it is a uniform shuffle."""
    parts = [F.lit(str(seed)), F.lit(salt)] + [_c(c).cast("string") for c in cols]
    return F.md5(F.concat_ws("|", *parts))


def hnum(seed: int, salt: str, *cols) -> Column:
    """Non-negative 60-bit integer from the key (for ``mod`` draws)."""
    return F.conv(F.substring(hkey(seed, salt, *cols), 1, _HEX), 16, 10).cast("long")


def hfrac(seed: int, salt: str, *cols) -> Column:
    """Uniform double in [0, 1) from the key (for threshold prefilters)."""
    return hnum(seed, salt, *cols) / F.lit(_SCALE)


# SQL spellings of the same keys, used by the DuckDB oracles.
def sql_hkey(seed: int, salt: str, *exprs: str) -> str:
    parts = [f"'{seed}'", f"'{salt}'"] + [f"CAST({e} AS VARCHAR)" for e in exprs]
    return f"md5(concat_ws('|', {', '.join(parts)}))"


def sql_hnum(seed: int, salt: str, *exprs: str) -> str:
    return f"CAST('0x' || substr({sql_hkey(seed, salt, *exprs)}, 1, {_HEX}) AS BIGINT)"
