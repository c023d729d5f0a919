"""Great-circle distance and coordinate boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def haversine_km(lat1, lng1, lat2, lng2, radius_km: float = EARTH_RADIUS_KM) -> Column:
    """Haversine distance in km; null if any coordinate is null.

    The asin argument is clamped to 1 so rounding on near-antipodal points cannot
    push it out of domain.
    """
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dlat = p2 - p1
    dlng = F.radians(_c(lng2)) - F.radians(_c(lng1))
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlng / 2), 2)
    s = F.sqrt(a)
    # clamp with CASE, not least(): least() skips nulls and would turn a null into 1.0
    return F.lit(2 * radius_km) * F.asin(F.when(s > 1.0, F.lit(1.0)).otherwise(s))


def in_box(lat, lng, lat_lo: float, lat_hi: float, lng_lo: float, lng_hi: float) -> Column:
    """True when the point lies inside the closed box (null coordinates -> null)."""
    return _c(lat).between(lat_lo, lat_hi) & _c(lng).between(lng_lo, lng_hi)
