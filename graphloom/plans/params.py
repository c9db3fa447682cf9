"""Parameter values and literals as Spark literals of their declared types."""

from __future__ import annotations

import datetime as dt
import decimal
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.errors import ParamError
from graphloom.plans.types import INTEGERS, PropType

NOW = "__now"
_JS_SAFE = 2**53 - 1


def parse_date(text: str) -> dt.date:
    try:
        return dt.date.fromisoformat(text[:10]) if len(text) == 10 else parse_datetime(text).date()
    except ValueError:
        raise ParamError(f"{text!r} is no date") from None


def parse_datetime(text: str) -> dt.datetime:
    """ISO 8601, in UTC, cut to milliseconds."""
    try:
        t = dt.datetime.fromisoformat(text.replace("Z", "+00:00").replace("z", "+00:00"))
    except ValueError:
        raise ParamError(f"{text!r} is no date and time") from None
    if t.tzinfo is not None:
        t = t.astimezone(dt.UTC).replace(tzinfo=None)
    return t.replace(microsecond=t.microsecond // 1000 * 1000)


def coerce(value: object, t: PropType, name: str = "value", *, js: bool = False) -> object:
    """A Python (or JSON) value as a value of type ``t``; ``js``: whole numbers beyond 2^53 must come as text."""
    bad = ParamError(f"{name}: {value!r} doesn't fit {t}")
    if value is None:
        raise ParamError(f"{name}: null isn't accepted")
    if t.vector:
        if not isinstance(value, (list, tuple)) or len(value) != t.dim or not all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in value):
            raise bad
        return [float(x) for x in value]
    if t.list:
        if not isinstance(value, (list, tuple)):
            raise bad
        return [coerce(x, PropType(t.scalar), name, js=js) for x in value]
    s = t.scalar
    if s == "String":
        if not isinstance(value, str):
            raise bad
        if t.enum and value not in t.enum:
            raise bad
        return value
    if s == "Bool":
        if not isinstance(value, bool):
            raise bad
        return value
    if s in INTEGERS:
        if isinstance(value, str):
            try:
                value = int(value)
            except ValueError:
                raise bad from None
        elif isinstance(value, bool) or not isinstance(value, (int, float)) or (isinstance(value, float) and (not js or not value.is_integer())):
            raise bad
        elif js and abs(value) > _JS_SAFE:
            raise ParamError(f"{name}: {value} isn't exact in JavaScript; pass it as text")
        low, high = INTEGERS[s]
        if not low <= value <= high:
            raise ParamError(f"{name}: {value} is out of the range of {s}")
        return int(value)
    if s in ("F32", "F64"):
        if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
            raise bad
        return float(value)
    if s == "Date":
        if isinstance(value, dt.date) and not isinstance(value, dt.datetime):
            return value
        if isinstance(value, int) and not isinstance(value, bool):
            return dt.date(1970, 1, 1) + dt.timedelta(days=value)
        if isinstance(value, str):
            return parse_date(value)
        raise bad
    if isinstance(value, dt.datetime):
        return parse_datetime(value.isoformat())
    if isinstance(value, int) and not isinstance(value, bool):
        return dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=value)
    if isinstance(value, str):
        return parse_datetime(value)
    raise bad


def literal(value: object, t: PropType) -> Column:
    """A coerced value as a Spark literal."""
    if t.vector or t.list:
        inner = t.spark().elementType
        return F.array(*[literal(x, PropType(t.scalar)) if not t.vector else F.lit(x).cast("float") for x in value]).cast(t.spark()) if value else F.array().cast(f"array<{inner.simpleString()}>")
    if t.scalar == "U64":
        return F.lit(decimal.Decimal(value)).cast(t.spark())
    if t.scalar == "DateTime":
        return F.lit(value.isoformat(sep=" ", timespec="milliseconds")).cast("timestamp_ntz")
    return F.lit(value).cast(t.spark())


def bind(declared: dict[str, PropType], given: dict | None, *, js: bool = False) -> dict[str, object]:
    """Check the given values against the declared parameters."""
    given = dict(given or {})
    if NOW in given or NOW in declared:
        raise ParamError(f"{NOW} is reserved")
    if extra := set(given) - set(declared):
        raise ParamError(f"unknown parameter ${min(extra)}")
    if missing := set(declared) - set(given):
        raise ParamError(f"parameter ${min(missing)} is missing")
    return {n: coerce(v, declared[n], f"${n}", js=js) for n, v in given.items()}
