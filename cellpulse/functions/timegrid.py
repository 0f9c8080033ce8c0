"""Fixed time grid of half-open buckets (lo, hi], numbered from 1."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, time, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MINUTE_MS = 60_000


def local_clock_ms(clock: str, day: date, zone: str = "America/New_York") -> int:
    """Milliseconds from UTC midnight of `day` to a local `hh:mm` on that day."""
    hours, minutes = clock.split(":")
    at = datetime.combine(day, time(int(hours), int(minutes)), ZoneInfo(zone))
    midnight = datetime.combine(day, time(0), timezone.utc)
    return int((at - midnight).total_seconds() * 1000)


@dataclass(frozen=True)
class Grid:
    """`n` buckets of `width_ms` from `start_ms`.

    Bucket t covers (start + (t-1)*width, start + t*width]. Rows at or before the
    start fall into bucket 1; rows at or after the end are outside the grid.
    """

    start_ms: int
    width_ms: int
    n: int

    @classmethod
    def between(cls, start_ms: int, end_ms: int, width_ms: int) -> Grid:
        """Whole buckets that fit between two instants; a shorter tail is left out."""
        return cls(start_ms, width_ms, (end_ms - start_ms) // width_ms)

    @property
    def end_ms(self) -> int:
        return self.start_ms + self.n * self.width_ms

    @property
    def width_minutes(self) -> float:
        return self.width_ms / MINUTE_MS

    def bucket(self, start_ms: Column) -> Column:
        """Bucket number, in whole-number arithmetic so that boundaries are exact."""
        past = start_ms - F.lit(self.start_ms) + F.lit(self.width_ms - 1)
        whole = F.call_function("div", past, F.lit(self.width_ms))
        # Rows of the grid are at most at bucket n; those long before it may lie beyond an int.
        return F.greatest(F.lit(1).cast("bigint"), F.least(whole, F.lit(self.n).cast("bigint"))).cast("int")

    def inside(self, start_ms: Column) -> Column:
        return start_ms < F.lit(self.end_ms)

    def upper_ms(self, t: Column) -> Column:
        """Upper boundary, the label of a bucket."""
        return F.lit(self.start_ms) + t.cast("bigint") * F.lit(self.width_ms)

    def minutes(self, t: Column) -> Column:
        """Whole minutes from the grid start to the end of the bucket."""
        return F.call_function(
            "div", t.cast("bigint") * F.lit(self.width_ms), F.lit(MINUTE_MS)
        )

    def per_minute(self, value: Column) -> Column:
        return value.cast("double") / F.lit(self.width_minutes)

    def assign(self, records: DataFrame) -> DataFrame:
        """Keep the rows inside the grid and add their bucket as `t`."""
        return records.where(self.inside(F.col("start_ms"))).withColumn(
            "t", self.bucket(F.col("start_ms"))
        )
