"""Lenient text-to-value parsing: failures become NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_SPECIAL = r"(?i)^[+-]?(inf|infinity|nan)$"

DAY_FIRST, MONTH_FIRST = "d/M/yyyy", "M/d/yyyy"
ISO = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")
#: clock patterns by number of colons, without and with AM/PM
CLOCKS = {0: (None, None), 1: ("H:mm", "h:mm a"), 2: ("H:mm:ss", "h:mm:ss a")}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(text: Column | str) -> Column:
    """Double behind a text, NULL when it is not a number (``inf`` and ``nan`` parse)."""
    t = F.trim(_col(text).cast("string"))
    return F.when(t.rlike(_NUMBER) | t.rlike(_SPECIAL), t.try_cast("double"))


def finite(value: Column | str) -> Column:
    """The value, with NaN and both infinities turned into NULL."""
    v = _col(value).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def timestamp(text: Column | str, day_first: bool = True) -> Column:
    """NTZ timestamp of a mixed-format text.

    The shape of the text (slashes, colons, AM/PM) names its pattern, so a value is
    parsed once; with ``day_first`` an impossible day-first date falls back to
    month-first, and the other way round.
    """
    t = F.trim(_col(text))
    colons = F.length(t) - F.length(F.replace(t, F.lit(":")))
    half_day = F.upper(F.right(t, F.lit(1))) == "M"
    days = (DAY_FIRST, MONTH_FIRST) if day_first else (MONTH_FIRST, DAY_FIRST)

    # a pattern whose month is above 12 cannot match: trying it would cost an exception
    place = {DAY_FIRST: F.substring_index(F.substring_index(t, "/", 2), "/", -1), MONTH_FIRST: F.substring_index(t, "/", 1)}
    above = {d: F.coalesce(month.rlike("^(?:1[3-9]|[2-9][0-9])$"), F.lit(False)) for d, month in place.items()}

    def either(clock: str | None) -> Column:
        return F.coalesce(*[F.when(~above[d], F.try_to_timestamp(t, F.lit(f"{d} {clock}" if clock else d))) for d in days])

    slashed, dashed = F.when(F.lit(False), F.lit(None).cast("timestamp")), F.when(F.lit(False), F.lit(None).cast("timestamp"))
    for n, (plain, half) in CLOCKS.items():
        if half:
            slashed = slashed.when((colons == n) & half_day, either(half))
        slashed = slashed.when(colons == n, either(plain))
    for pattern in ISO:
        shape = (colons == pattern.count(":")) & (F.contains(t, F.lit("T")) == F.lit("'T'" in pattern))
        dashed = dashed.when(shape, F.try_to_timestamp(t, F.lit(pattern)))
    return F.when(F.contains(t, F.lit("/")), slashed).otherwise(dashed).cast("timestamp_ntz")


def bind(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that the optimizer does not copy into each of their uses."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def micros(ts: Column | str) -> Column:
    """Epoch microseconds as a long."""
    return F.unix_micros(_col(ts).cast("timestamp"))


def two_decimals(value: Column | str) -> Column:
    """A non-negative double as text with two decimals, rounded on its exact binary value.

    Java's formatter rounds the shortest decimal form instead and differs on
    ties such as 5.215. The error of ``value * 1000`` is exact after splitting
    the value in two halves (Dekker), and decides such ties.
    """
    x = _col(value).cast("double")
    mills = x * 1000.0
    big = x * 134217729.0
    high = big - (big - x)
    error = (high * 1000.0 - mills) + (x - high) * 1000.0
    cents = F.floor(mills / 10.0)
    rest = mills - cents * 10.0
    even_up = (error == 0) & (cents % 2 == 1)
    up = (rest > 5) | ((rest == 5) & ((error > 0) | even_up))
    total = cents + F.when(up, 1).otherwise(0)
    return F.format_string("%d.%02d", F.floor(total / 100).cast("long"), (total % 100).cast("long"))


def pack_id(c: Column | str) -> Column:
    """An id as bytes, for joins that shuffle it: ids of lower-case hex text take half the room.

    Different ids give different bytes, and ``unpack_id`` gives the id back, whatever it holds.
    """
    text = _col(c)
    raw = F.unhex(text)
    return F.when(F.lower(F.hex(raw)) == text, F.concat(F.lit(b"\x01"), raw)).otherwise(F.concat(F.lit(b"\x00"), text.cast("binary")))


def unpack_id(c: Column | str) -> Column:
    packed = _col(c)
    rest = F.substring(packed, 2, 2**31 - 1)
    return F.when(F.substring(packed, 1, 1) == F.lit(b"\x01"), F.lower(F.hex(rest))).otherwise(rest.cast("string"))
