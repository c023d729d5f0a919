"""Column-expression helpers (all JVM-side built-ins, no Python UDFs)."""

from ledgerlens.functions.temporal import (  # noqa: F401
    epoch_micros, fractional_days, hours_between, micros_between, month_label,
    month_start, plus_days, weekday_mon0, whole_days_between,
)
from ledgerlens.functions.geo import haversine_km, in_box  # noqa: F401
from ledgerlens.functions.numeric import pct_diff, safe_ratio  # noqa: F401
