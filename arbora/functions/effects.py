"""Effect tags of tasks."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F


class Effect(Enum):
    """What a task does besides giving a value."""

    PURE = "pure"
    READ = "read"
    WRITE = "write"
    NETWORK = "network"
    NONDETERMINISTIC = "nondeterministic"

    @property
    def cacheable(self) -> bool:
        return self in (Effect.PURE, Effect.READ)


def effect_of(value: object) -> Effect:
    try:
        return value if isinstance(value, Effect) else Effect(str(value).lower())
    except ValueError:
        return Effect.PURE


def effect_column(value: Column) -> Column:
    low = F.lower(value)
    return F.when(low.isin([e.value for e in Effect]), low).otherwise(F.lit(Effect.PURE.value))
