"""A normalised ticket frame that remembers which columns its input really had."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import DataFrame

from turnstile import constants as C
from turnstile.functions.normalise import normalise


class MetricUnavailable(Exception):
    """A metric needs a column the input does not have."""


@dataclass(frozen=True)
class Tickets:
    """``rows`` has every column; ``present`` names the ones that are not filler nulls."""

    rows: DataFrame
    present: frozenset[str]

    @classmethod
    def from_raw(
        cls, raw: DataFrame, as_of: date | datetime, channel: str | None = C.ONLINE
    ) -> Tickets:
        rows, present = normalise(raw, as_of, channel)
        return cls(rows, present)

    @property
    def has_door(self) -> bool:
        return "door_price" in self.present

    def has(self, *columns: str) -> bool:
        return all(c in self.present for c in columns)

    def require(self, *columns: str) -> DataFrame:
        missing = sorted(c for c in columns if c not in self.present)
        if missing:
            raise MetricUnavailable(", ".join(missing))
        return self.rows
