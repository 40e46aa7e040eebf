"""Zone-free time arithmetic on ``timestamp_ntz``.

``unix_micros`` needs a zoned timestamp, and casting through the session zone moves
values at daylight-saving changes; these work on the wall-clock fields alone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def wall_us(at: Column) -> Column:
    """Microseconds of a zone-free timestamp since 1970-01-01 00:00 on the same clock."""
    seconds = F.unix_date(at.cast("date")) * F.lit(86_400).cast("bigint") + F.hour(at) * 3600 + F.minute(at) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("bigint")
