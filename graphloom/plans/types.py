"""The languages' types and what they are in Spark."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

SCALARS = ("String", "Bool", "I32", "I64", "U32", "U64", "F32", "F64", "DateTime", "Date")
NUMERIC = ("I32", "I64", "U32", "U64", "F32", "F64")
INTEGERS = {"I32": (-(2**31), 2**31 - 1), "I64": (-(2**63), 2**63 - 1), "U32": (0, 2**32 - 1), "U64": (0, 2**64 - 1)}
_SPARK = {
    "String": T.StringType(), "Bool": T.BooleanType(), "I32": T.IntegerType(), "I64": T.LongType(), "U32": T.LongType(),
    "U64": T.DecimalType(20, 0), "F32": T.FloatType(), "F64": T.DoubleType(), "Date": T.DateType(), "DateTime": T.TimestampNTZType(),
}


@dataclass(frozen=True)
class PropType:
    """A scalar, a list of scalars, an enum (strings of a set) or a vector of a fixed length."""

    scalar: str
    nullable: bool = False
    list: bool = False
    dim: int | None = None
    enum: tuple[str, ...] = ()

    @property
    def numeric(self) -> bool:
        return self.scalar in NUMERIC and not self.list and self.dim is None

    @property
    def vector(self) -> bool:
        return self.dim is not None

    def spark(self) -> T.DataType:
        if self.vector:
            return T.ArrayType(T.FloatType())
        t = _SPARK[self.scalar]
        return T.ArrayType(t) if self.list else t

    def __str__(self) -> str:
        core = f"Vector({self.dim})" if self.vector else f"enum({', '.join(self.enum)})" if self.enum else self.scalar
        return (f"[{core}]" if self.list else core) + "?" * self.nullable


def compatible(a: PropType, b: PropType) -> bool:
    """May values of the two be compared?"""
    if a.list != b.list or a.vector != b.vector:
        return False
    if a.vector:
        return a.dim == b.dim
    return a.scalar == b.scalar or (a.scalar in NUMERIC and b.scalar in NUMERIC)
