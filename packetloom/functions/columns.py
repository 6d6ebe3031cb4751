"""Small column expressions used across operators; all stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# RFC 1918 ranges plus loopback.
PRIVATE_IP_PATTERN = r"^(10\.|192\.168\.|127\.|172\.(1[6-9]|2[0-9]|3[0-1])\.)"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def private_ip(ip) -> Column:
    return F.coalesce(col(ip).rlike(PRIVATE_IP_PATTERN), F.lit(False))


def as_int(flag) -> Column:
    """Boolean or numeric flag as 0/1 with null read as 0."""
    return F.coalesce(col(flag).cast("int"), F.lit(0))


def ratio(num, den, floor: float = 1.0) -> Column:
    """num / max(den, floor)."""
    return col(num).cast("double") / F.greatest(col(den).cast("double"), F.lit(float(floor)))


def clip(x, lo, hi) -> Column:
    return F.least(F.greatest(col(x), F.lit(lo)), F.lit(hi))


def finite_or(x, default: float = 0.0) -> Column:
    """Replace null, NaN and infinities."""
    x = col(x).cast("double")
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(bad, F.lit(float(default))).otherwise(x)


def entropy_term(p) -> Column:
    """One addend of Shannon entropy in bits, with the usual 1e-12 guard."""
    p = col(p)
    return -p * F.log2(p + F.lit(1e-12))


def seconds(us) -> Column:
    return col(us) / F.lit(1e6)


def q6(x, digits: int = 6) -> Column:
    """Half-up rounding by plain arithmetic so that other engines agree bit for bit."""
    scale = F.lit(float(10**digits))
    return F.floor(col(x).cast("double") * scale + F.lit(0.5)) / scale


def seeded_hash(seed: int, *keys) -> Column:
    """Portable pseudo-random BIGINT in [0, 2^60) from the key columns and a seed."""
    text = F.concat_ws("|", F.lit(str(seed)), *[col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
