"""Calendar durations such as 1y5m7d2h, and moving a time back by one."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.model import RepositoryError

_UNITS = {"y": "years", "m": "months", "d": "days", "h": "hours"}


@dataclass(frozen=True)
class Duration:
    hours: int = 0
    days: int = 0
    months: int = 0
    years: int = 0

    @classmethod
    def parse(cls, text: str) -> Duration:
        """Numbers with the units y, m, d, h in any order; a unit given again replaces the first."""
        found: dict[str, int] = {}
        rest = text
        while rest:
            m = re.match(r"([+-]?\d+)([a-z]?)", rest)
            if not m or not m[2]:
                raise RepositoryError(f"no number or unit found in {text!r}")
            if m[2] not in _UNITS:
                raise RepositoryError(f"invalid unit {m[2]!r} in {text!r}")
            found[_UNITS[m[2]]] = int(m[1])
            rest = rest[m.end() :]
        return cls(**found)

    def __str__(self) -> str:
        return "".join(f"{getattr(self, name)}{u}" for u, name in _UNITS.items() if getattr(self, name))

    def __bool__(self) -> bool:
        return any((self.hours, self.days, self.months, self.years))

    @property
    def negative(self) -> bool:
        return min(self.hours, self.days, self.months, self.years) < 0


def before(time: Column, d: Duration) -> Column:
    """``time`` moved back: months first, where a day that the month lacks runs on into the next, then days and hours."""
    month = F.add_months(F.trunc(time, "MM"), -(12 * d.years + d.months))
    day = F.date_add(month, F.dayofmonth(time) - 1 - d.days)
    rest = time.cast("timestamp") - F.date_trunc("day", time)
    return day.cast("timestamp") + rest - F.make_dt_interval(F.lit(0), F.lit(d.hours))
