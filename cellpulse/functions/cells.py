"""Cell and station identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellpulse.schema import FIRST_MEASURED_FIELD, STATION_CODE_LENGTH

# Up to 7fffffffffffffff, with any number of leading zeros.
_BIGINT_HEX = "^0*[0-7]?[0-9a-fA-F]{1,15}$"


def station_of(cell: Column) -> Column:
    """Station code of a cell id: its first 13 characters, null when empty."""
    return F.nullif(F.substring(cell, 1, STATION_CODE_LENGTH), F.lit(""))


def station_number(station: Column) -> Column:
    """Decimal station id: the last `:` part read as hexadecimal.

    Every id that fits a bigint is read; see `unreadable_station` for the others.
    """
    tail = F.substring_index(station, ":", -1)
    # conv() gives 0 for text that is not a number, so test the text first.
    return F.when(tail.rlike(_BIGINT_HEX), F.conv(tail, 16, 10).cast("bigint"))


def unreadable_station(station: Column) -> Column:
    """Whether a station has a code whose number is null: not hexadecimal, or beyond a bigint."""
    return station.isNotNull() & station_number(station).isNull()


def measured_stations(line: Column) -> Column:
    """Stations in the measured-cell list at the end of a record line.

    The list counts only when the line holds a `[`; its entries are the fields
    from 251 on that hold a `:`. Read off the text, without splitting the line.
    """
    before = F.substring_index(line, ";", FIRST_MEASURED_FIELD - 1)
    tail = F.substring(line, F.length(before) + 1, F.length(line))
    # A field that holds a `:`, up to the length of a station code.
    entry = rf";(?=[^;]*:)([^;]{{1,{STATION_CODE_LENGTH}}})"
    return F.when(
        line.contains("["), F.regexp_extract_all(tail, F.lit(entry), F.lit(1))
    ).otherwise(F.array().cast("array<string>"))
