"""Frequencies: the bins of time they cut, as column arithmetic.

A frequency numbers its bins by whole numbers. ``index`` gives the number of a time
and ``label`` the time that stands for a number, so bins need no calendar table,
and neither depends on the session's time zone. A multiple (``2W``, ``7h``) joins
bins from the one that holds a series' first time.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from seriesloom.sources.frame import at_micros, micros

# Microseconds of the clock units, months of the calendar ones, and the
# names of days and months that anchor weeks, quarters and years.
CLOCK = {"s": 1_000_000, "min": 60_000_000, "h": 3_600_000_000, "D": 86_400_000_000}
MONTHS = {"M": 1, "Q": 3, "Y": 12}
SAME = {"S": "s", "T": "min", "H": "h", "d": "D", "M": "ME", "Q": "QE", "A": "YE", "Y": "YE", "AS": "YS"}
DAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")
MONTH_NAMES = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
_FORM = re.compile(r"(\d*)([A-Za-z]+)(?:-([A-Z]{3}))?")


@dataclass(frozen=True)
class Frequency:
    unit: str
    n: int = 1
    #: The day a week ends on, or the month a quarter or year begins in or ends with.
    anchor: int = 0

    @staticmethod
    def of(text: str) -> Frequency:
        """``15min``, ``2h``, ``D``, ``B``, ``W-MON``, ``MS``, ``QE-NOV``, ``YS`` ..."""
        m = _FORM.fullmatch(text) if isinstance(text, str) else None
        unit = SAME.get(m[2], m[2]) if m else ""
        known = unit in CLOCK or unit in ("B", "W") or (unit[:1] in MONTHS and unit[1:] in ("S", "E"))
        names = DAYS if unit == "W" else MONTH_NAMES if unit[:1] in ("Q", "Y") and known else ()
        if not known or (m[3] and m[3] not in names) or m[1] == "0" or (m[1] and int(m[1]) < 1):
            raise ValueError(f"unknown frequency {text!r}")
        usual = 6 if unit == "W" else 11 if unit[1:] == "E" else 0
        return Frequency(unit, int(m[1] or 1), names.index(m[3]) if m[3] else usual)

    @property
    def ends(self) -> bool:
        """Whether a bin is named by its last day."""
        return self.unit == "W" or self.unit in ("ME", "QE", "YE")

    @property
    def floating(self) -> bool:
        """Whether bins are counted from each series' own first time."""
        if self.unit in CLOCK:
            return CLOCK["D"] % (CLOCK[self.unit] * self.n) != 0
        return self.n > 1

    def _number(self, ts: Column) -> Column:
        day = F.unix_date(F.to_date(ts)).cast("long")  # day 0 was a Thursday
        if self.unit == "W":
            return F.floor((day + 3 - self.anchor + 6) / 7)
        if self.unit == "B":
            return F.floor((day + 3) / 7) * 5 + F.least(F.pmod(day + 3, F.lit(7)), F.lit(4))
        size = MONTHS[self.unit[0]]
        months = (F.year(ts) * 12 + F.month(ts) - 1 - self.anchor).cast("long")
        return (F.ceil if self.ends else F.floor)(months / size)

    def index(self, ts: Column, first: Column | None = None) -> Column:
        """The number of the bin that holds a time; first: the series' first time,
        where ``floating``."""
        if self.unit in CLOCK:
            start = F.lit(0) if first is None or not self.floating else F.floor(micros(first) / CLOCK["D"]) * CLOCK["D"]
            return F.floor((micros(ts) - start) / (CLOCK[self.unit] * self.n))
        k = self._number(ts)
        if self.n == 1 or first is None:
            return k
        return (F.ceil if self.ends else F.floor)((k - self._number(first)) / self.n)

    def label(self, k: Column, first: Column | None = None) -> Column:
        """The time that names bin ``k``."""
        if self.unit in CLOCK:
            start = F.lit(0) if first is None or not self.floating else F.floor(micros(first) / CLOCK["D"]) * CLOCK["D"]
            return at_micros(start + k * (CLOCK[self.unit] * self.n))
        if self.n > 1 and first is not None:
            k = self._number(first) + k * self.n
        epoch = F.lit("1970-01-01").cast("date")
        if self.unit == "W":
            return F.date_add(epoch, (k * 7 - 3 + self.anchor).cast("int")).cast("timestamp_ntz")
        if self.unit == "B":
            return F.date_add(epoch, (F.floor(k / 5) * 7 - 3 + F.pmod(k, F.lit(5))).cast("int")).cast("timestamp_ntz")
        months = k * MONTHS[self.unit[0]] + self.anchor
        day = F.make_date(F.floor(months / 12).cast("int"), (F.pmod(months, F.lit(12)) + 1).cast("int"), F.lit(1))
        return (F.last_day(day) if self.ends else day).cast("timestamp_ntz")
