"""Column expressions for text, numbers and time."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks for "no value" in Zeek logs.
SENTINELS = ("-", "(empty)")


def quoted(name: str) -> Column:
    """A top-level column by exact name, also when the name holds dots."""
    return F.col("`" + name.replace("`", "``") + "`")


# Characters counted as white space at the ends of a text.
WHITE_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(col: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.btrim(col, F.lit(WHITE_SPACE))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def null_sentinels(col: Column, values: Iterable[str] = SENTINELS) -> Column:
    """Sentinel texts become NULL."""
    return F.when(~col.isin(*values), col)


def to_num(col: Column, fill: float | None = None) -> Column:
    """Text or number to double; unreadable text becomes NULL, or ``fill``."""
    number = F.nanvl(col.try_cast("double"), F.lit(None).cast("double"))
    return number if fill is None else F.coalesce(number, F.lit(float(fill)))


def to_ts(col: Column) -> Column:
    """Epoch seconds (text or number) to timestamp; unreadable text becomes NULL."""
    return F.timestamp_seconds(col.try_cast("double"))


def clean_number(col: Column, fill: float | None = 0.0) -> Column:
    """float32 value with NULL, NaN and both infinities replaced by ``fill``."""
    value = col.cast("float")
    finite = F.when(
        value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")).cast("float")),
        value,
    )
    return finite if fill is None else F.coalesce(finite, F.lit(fill).cast("float"))


def hash_order(seed: int | str, *keys: Column) -> Column:
    """Seeded md5 text of a row key: a reproducible random order.

    The order depends on the key alone, never on files or partitions, so a sample
    is the same on one core and on a thousand executors.
    """
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def below_fraction(hashed: Column, fraction: float) -> Column:
    """True for the given share of all possible hash texts (first eight hex digits)."""
    if fraction >= 1.0:
        return F.lit(True)
    return F.substring(hashed, 1, 8) < F.lit(f"{int(fraction * 16**8):08x}")
