"""Encoders: columns to codes 0 .. size - 1.

A domain is fixed before the data is seen; none of these looks at the data.  Values
outside it follow the policy: error, clamp (to the nearest code; unlisted values of a
dictionary count as outside and can't be clamped), drop (code null, dropped by the
histogram).  Null is outside too unless null_code gives it the extra code ``size - 1``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

POLICIES = ("error", "clamp", "drop")


@dataclass(frozen=True)
class Encoder:
    """kind: dictionary (values in order), integer (value - low), scaled (round(value * scale) - low), buckets (edges), expression (SQL giving the code)."""

    kind: str
    column: str = ""
    values: tuple = field(default=())
    low: int = 0
    scale: float = 1.0
    policy: str = "error"
    null_code: bool = False

    def __post_init__(self):
        if self.policy not in POLICIES:
            raise ValueError(f"unknown policy {self.policy!r}")
        if self.kind == "dictionary" and self.policy == "clamp":
            raise ValueError("a dictionary has no nearest code")

    def code(self, size: int) -> Column:
        c = F.col(self.column) if self.column else None
        real = size - 1 if self.null_code else size
        if self.kind == "dictionary":
            raw = F.array_position(F.array(*map(F.lit, self.values)), c).cast("long") - 1
            raw = F.when(c.isNull(), None).otherwise(raw)
        elif self.kind == "integer":
            raw = c.cast("long") - self.low
        elif self.kind == "scaled":
            raw = F.round(c * self.scale).cast("long") - self.low
        elif self.kind == "buckets":
            raw = F.when(c.isNotNull(), sum((F.when(c >= e, 1).otherwise(0) for e in self.values), F.lit(0))) - 1
        elif self.kind == "expression":
            raw = F.expr(self.values[0]).cast("long")
        else:
            raise ValueError(f"unknown encoder {self.kind!r}")
        if self.policy == "clamp":
            out = F.least(F.greatest(raw, F.lit(0)), F.lit(real - 1))
            out = F.when(raw.isNotNull(), out)
        else:
            inside = (raw >= 0) & (raw < real)
            out = F.when(inside, raw)
            if self.policy == "error":
                out = F.when(inside | raw.isNull(), raw).otherwise(F.raise_error(F.lit(f"value of {self.column or self.values} is outside its domain")))
        if self.null_code:
            out = F.when(raw.isNull(), F.lit(size - 1)).otherwise(out)
        elif self.policy == "error":
            out = F.when(raw.isNotNull(), out).otherwise(F.raise_error(F.lit(f"null in {self.column or self.values}")))
        return out.cast("int")


def dictionary(column: str, values: Sequence, **options) -> Encoder:
    return Encoder("dictionary", column, tuple(values), **options)


def integer(column: str, low: int = 0, **options) -> Encoder:
    return Encoder("integer", column, low=low, **options)


def scaled(column: str, scale: float, low: int = 0, **options) -> Encoder:
    return Encoder("scaled", column, scale=scale, low=low, **options)


def buckets(column: str, edges: Sequence[float], **options) -> Encoder:
    """Code i: edges[i] <= value < edges[i + 1]; the last bucket is open."""
    return Encoder("buckets", column, tuple(edges), **options)


def expression(sql: str, **options) -> Encoder:
    return Encoder("expression", values=(sql,), **options)
