"""Random numbers as columns: a keyed hash, the same under any partitioning and in any SQL engine with md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A draw is one of so many integers.
RANGE = 1 << 28


def draw(salt: int | str, *keys: Column | str) -> Column:
    """An integer in [0, RANGE) for the salt and the keys: the first 28 bits of md5 of their text, joined by colons."""
    text = F.concat_ws(":", F.lit(str(salt)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long")


def fires(p: Column | str, salt: int | str, *keys: Column | str) -> Column:
    """Whether an event of probability p happens for these keys."""
    return draw(salt, *keys) < threshold(p)


def threshold(p: Column | str) -> Column:
    return F.floor((F.col(p) if isinstance(p, str) else p) * float(RANGE))


def uniform(salt: int | str, *keys: Column | str) -> Column:
    """A double in (0, 1)."""
    return (draw(salt, *keys) + 0.5) / float(RANGE)


def draw_sql(salt: int | str, *keys: str) -> str:
    """The same in DuckDB."""
    return f"('0x'||substr(md5(concat_ws(':','{salt}',{','.join(keys)})),1,7))::BIGINT"


def fires_sql(p: str, salt: int | str, *keys: str) -> str:
    return f"({draw_sql(salt, *keys)} < floor(({p}) * {float(RANGE)}::DOUBLE))"
