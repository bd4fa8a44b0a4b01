"""Types of the dialect, coercion on write, time parsing, and the small formulas that the analytics use."""

from __future__ import annotations

import datetime as dt
import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPARK_TYPES = {"INT": T.IntegerType(), "BIGINT": T.LongType(), "DECIMAL": T.DoubleType(), "VARCHAR": T.StringType(), "BOOLEAN": T.BooleanType(), "TIMESTAMP": T.TimestampType()}
EPSILON = 1e-4
_FORMATS = ("%d/%m/%Y %H:%M:%S", "%d/%m/%Y %H:%M", "%d/%m/%Y", "%d-%m-%Y %H:%M:%S", "%d-%m-%Y", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d", "%Y/%m/%d", "%Y-%m-%dT%H:%M:%S")
_AGO = re.compile(r"(?i)^\s*(\d+)\s+(second|minute|hour|day)s?\s+ago\s*$")
_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
TRUE_WORDS, FALSE_WORDS = ("true", "1", "yes"), ("false", "0", "no")


class CoercionError(ValueError):
    """A value that its column can't hold."""


def parse_time(text: str) -> dt.datetime:
    """A written time in UTC: day first, or year first where the first field is a year."""
    for f in _FORMATS:
        try:
            return dt.datetime.strptime(text.strip(), f)
        except ValueError:
            pass
    raise CoercionError(f"no time: {text!r}")


def as_of_micros(value: int | str, now: dt.datetime | None = None) -> int:
    """Microseconds of an AS OF or RECOVER operand: a number is microseconds; a text is a date, digits (seconds) or 'N units ago'."""
    if isinstance(value, int):
        return value
    if value.strip().isdigit():
        return int(value) * 1_000_000
    if m := _AGO.match(value):
        at = (now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)) - dt.timedelta(seconds=int(m[1]) * _UNITS[m[2].lower()])
    else:
        at = parse_time(value)
    return (at - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)


def coerce(value: Any, kind: str) -> Any:
    """A literal as its column holds it; INSERT and UPDATE share this."""
    if value is None:
        return None
    try:
        if kind in ("INT", "BIGINT"):
            if isinstance(value, bool):
                raise CoercionError(f"no number: {value!r}")
            out = int(value)
            bits = 31 if kind == "INT" else 63
            if not -(1 << bits) <= out < 1 << bits:
                raise CoercionError(f"out of range for {kind}: {value!r}")
            return out
        if kind == "DECIMAL":
            if isinstance(value, bool):
                raise CoercionError(f"no number: {value!r}")
            return float(value)
        if kind == "VARCHAR":
            if isinstance(value, float):
                raise CoercionError("a decimal is no text")
            return str(value).lower() if isinstance(value, bool) else str(value)
        if kind == "BOOLEAN":
            if isinstance(value, bool):
                return value
            if isinstance(value, int):
                return value != 0
            if isinstance(value, str) and value.lower() in TRUE_WORDS + FALSE_WORDS:
                return value.lower() in TRUE_WORDS
        if kind == "TIMESTAMP":
            if isinstance(value, str):
                return parse_time(value)
            if isinstance(value, int) and not isinstance(value, bool):
                return dt.datetime(1970, 1, 1) + dt.timedelta(seconds=value)
    except ValueError as e:
        raise CoercionError(str(e)) from None
    raise CoercionError(f"{value!r} is no {kind}")


def timestamp_column(c: Column) -> Column:
    """Written times as timestamps, by the first format that reads them; null where none does."""
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for f in ("dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "dd/MM/yyyy", "dd-MM-yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")))


def boolean_column(c: Column) -> Column:
    low = F.lower(c.cast("string"))
    return F.when(low.isin(*TRUE_WORDS), True).when(low.isin(*FALSE_WORDS), False)


def approx_eq(a: Column, b: Column | float, eps: float = EPSILON) -> Column:
    return F.abs(a - (b if isinstance(b, Column) else F.lit(b))) < eps


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def bucket_floor(us: Column, width: int = 1_000_000) -> Column:
    return F.floor(us / width) * width


def reward(ms: Column) -> Column:
    return 1.0 / (1.0 + ms / 100.0)


def ucb1(q: Column, pulls: Column, total: Column, c: float = 1.414) -> Column:
    return F.when(pulls == 0, F.lit(float("inf"))).otherwise(q + c * F.sqrt(F.ln(total.cast("double")) / pulls))


def z_score(x: Column, mean: Column, sd: Column) -> Column:
    """The z-score with the rule for flat histories: a burst of 5 rows a second or more counts as 3.5 where there was nothing."""
    flat = F.when((x >= 5.0) & ((mean <= 0.001) | (x >= 10.0 * mean)), 3.5).otherwise(0.0)
    return F.when(sd < 0.01, flat).otherwise((x - mean) / sd)


def severity(z: Column) -> Column:
    a = F.abs(z)
    return F.when(a >= 4, "HIGH").when(a >= 3, "MEDIUM").when(a >= 2, "LOW").otherwise("NONE")


def mass_severity(rows: Column) -> Column:
    return F.when(rows >= 500, "HIGH").when(rows >= 200, "MEDIUM").when(rows >= 50, "LOW").otherwise("NONE")


def decay_factor(queries: Column) -> Column:
    """How much of the learned pulls an interval's activity leaves."""
    r = queries / 100.0
    return F.when(queries < 5, 1.0).when(r <= 1.0, 1.0 - 0.2 * r).otherwise(0.8 - 0.2 * F.least((r - 1.0) / 2.0, F.lit(1.0)))
