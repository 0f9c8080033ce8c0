"""Great-circle distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0
# Fixed value: scale used by the older form, which takes degrees as if they were radians.
LEGACY_SCALE = 63.67


def distance_km(lat1, lon1, lat2, lon2, legacy_distance: bool = False) -> Column:
    """Haversine distance in km between two points given in degrees.

    `legacy_distance` reproduces the older form, without the conversion to radians.
    """
    as_angle = (lambda c: c) if legacy_distance else F.radians
    lat1, lon1, lat2, lon2 = (
        as_angle(c if isinstance(c, Column) else F.lit(float(c))) for c in (lat1, lon1, lat2, lon2)
    )
    half_chord = F.pow(F.sin((lat2 - lat1) / 2), F.lit(2.0)) + F.cos(lat1) * F.cos(lat2) * F.pow(
        F.sin((lon2 - lon1) / 2), F.lit(2.0)
    )
    return F.asin(F.sqrt(half_chord)) * (2 * (LEGACY_SCALE if legacy_distance else EARTH_RADIUS_KM))
