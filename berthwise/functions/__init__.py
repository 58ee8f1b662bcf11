"""Scalar Column expressions (JVM-side, whole-stage-codegen friendly)."""

from berthwise.functions.time import (
    EPOCH, to_us, from_us, hours_between, us_to_hours, parse_day_first, add_hours,
    HOUR_US, MINUTE_US,
)
from berthwise.functions.scalar import (
    clip_nonneg, leading_number, normalize_key, overlaps, is_direct, plan_wait_hours,
    null_if_no_cargo, cargo_array, text_or_null, num_or,
)

__all__ = [
    "EPOCH", "to_us", "from_us", "hours_between", "us_to_hours", "parse_day_first",
    "add_hours", "HOUR_US", "MINUTE_US", "clip_nonneg", "leading_number",
    "normalize_key", "overlaps", "is_direct", "plan_wait_hours", "null_if_no_cargo",
    "cargo_array", "text_or_null", "num_or",
]
