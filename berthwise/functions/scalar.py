"""Scalar predicates and cleaners used across operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from berthwise import schema as S


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clip_nonneg(x) -> Column:
    """max(x, 0) that keeps NULL as NULL (``greatest`` would turn NULL into 0)."""
    x = _c(x)
    return F.when(x.isNull(), F.lit(None)).otherwise(F.greatest(x, F.lit(0.0)))


def leading_number(x, default: float = 0.0) -> Column:
    """``"9 to 10"`` -> 9.0, ``"12"`` -> 12.0, missing/junk -> ``default``."""
    first = F.split(F.trim(_c(x).cast("string")), " ").getItem(0)
    return F.coalesce(first.try_cast("double"), F.lit(float(default)))


def normalize_key(x) -> Column:
    """Key as trimmed text; NULL stays NULL."""
    return F.trim(_c(x).cast("string"))


def overlaps(a_start, a_end, b_start, b_end) -> Column:
    """Half-open interval overlap: [a_s, a_e) and [b_s, b_e) intersect."""
    return (_c(a_start) < _c(b_end)) & (_c(a_end) > _c(b_start))


def is_direct(wait_hours) -> Column:
    """Direct berthing: wait strictly below 0.1 h."""
    return _c(wait_hours) < F.lit(S.DIRECT_BERTHING_HOURS)


def plan_wait_hours(start_us, eta_us) -> Column:
    """max(0, start - eta) in hours from microsecond columns."""
    d = _c(start_us) - _c(eta_us)
    return F.when(d.isNull(), F.lit(None)).otherwise(F.greatest(d, F.lit(0)) / F.lit(3.6e9))


def null_if_no_cargo(x) -> Column:
    """Trimmed cargo text, NULL when it is one of the 'no cargo' spellings."""
    t = F.trim(_c(x))
    return F.when(t.isin(*S.NO_CARGO_TEXTS), F.lit(None)).otherwise(t)


def cargo_array(imp, exp) -> Column:
    """Null-free, de-duplicated array of a call's cargos (possibly empty)."""
    return F.array_distinct(F.array_compact(F.array(null_if_no_cargo(imp), null_if_no_cargo(exp))))


def text_or_null(x) -> Column:
    """Trimmed text; NULL stays NULL."""
    return F.trim(_c(x).cast("string"))


def num_or(x, default) -> Column:
    """Numeric value of a text/number column, ``default`` when NULL or non-numeric."""
    return F.coalesce(F.trim(_c(x).cast("string")).try_cast("double"), F.lit(float(default)))
