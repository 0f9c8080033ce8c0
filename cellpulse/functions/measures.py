"""Per-record predicates and measures shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellpulse.schema import ATTEMPT_PROCEDURES, LAST_GOOD_CFC, RELEASE_PROCEDURES


def count_where(condition: Column) -> Column:
    """Number of rows where the condition holds; null counts as false."""
    return F.count(F.when(condition, F.lit(1)))


def is_release(proc_id: Column) -> Column:
    return proc_id.isin(*RELEASE_PROCEDURES)


def is_attempt(proc_id: Column) -> Column:
    """Procedures that can fail."""
    return proc_id.isin(*ATTEMPT_PROCEDURES)


def is_failure(cfc: Column) -> Column:
    """A completion code is present and above 1."""
    return cfc > F.lit(LAST_GOOD_CFC)


def bler_sum(*samples: Column) -> Column:
    """Sum of the block-error samples that are present."""
    total = F.lit(0).cast("bigint")
    for s in samples:
        total = total + F.coalesce(s, F.lit(0))
    return total


def bler_count(*samples: Column) -> Column:
    """How many block-error samples are present."""
    total = F.lit(0).cast("bigint")
    for s in samples:
        total = total + s.isNotNull().cast("int")
    return total


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient as double, 0.0 where the denominator is not positive."""
    return F.when(denominator > 0, numerator.cast("double") / denominator).otherwise(F.lit(0.0))


def fixed(value: Column, digits: int) -> Column:
    """Text with a fixed number of decimals, for sinks."""
    return F.format_string(f"%.{digits}f", value.cast("double"))
