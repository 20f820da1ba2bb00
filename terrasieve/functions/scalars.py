"""Scalar column functions with the null rules of the studies."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0088  # fixed value
CLIP = 8.0


def missing_as_null(col: Column) -> Column:
    """NaN becomes NULL, so that aggregates skip it."""
    return F.nullif(col, F.lit(float("nan")))


def to_number(col: Column) -> Column:
    """Value as double; what is no number, NaN included, becomes NULL."""
    return missing_as_null(col.try_cast("double"))


def is_close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def any_true(tests: Sequence[Column]) -> Column:
    """OR over tests in which null counts as false."""
    return reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests])


def strip_prefix(col: Column, prefix: str) -> Column:
    return F.when(col.startswith(prefix), F.substring(col, F.lit(len(prefix) + 1), F.length(col))).otherwise(col)


def normalised_name(col: Column) -> Column:
    """Lower case, trimmed, letters a-z and digits only."""
    return F.regexp_replace(F.lower(F.trim(col)), "[^a-z0-9]+", "")


def pair_key(a: Column, b: Column, directed: Column) -> Column:
    """``a -> b`` for directed pairs, else the sorted pair ``x -- y``."""
    return F.when(directed, F.concat_ws(" -> ", a, b)).otherwise(F.concat_ws(" -- ", F.least(a, b), F.greatest(a, b)))


def padded(prefix: str, col: Column, width: int = 2) -> Column:
    return F.concat(F.lit(prefix), F.lpad(col.cast("string"), width, "0"))


def clipped(col: Column, bound: float = CLIP) -> Column:
    return F.greatest(F.lit(-bound), F.least(F.lit(bound), col))


def sigmoid(col: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col))


def round_half_even(col: Column, digits: int) -> Column:
    return F.bround(col, digits)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance of points in degrees."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def row_median(cols: Sequence[Column]) -> Column:
    """Median over columns of a row, nulls left out; null if all are."""
    kept = F.array_sort(F.array_compact(F.array(*cols)))
    n = F.size(kept)
    low, high = F.get(kept, F.floor((n - 1) / 2).cast("int")), F.get(kept, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def row_max(cols: Sequence[Column]) -> Column:
    return F.greatest(*cols) if len(cols) > 1 else cols[0]


def joined_set(col: Column, sep: str = ";") -> Column:
    """Aggregate: the different values, sorted and joined."""
    return F.array_join(F.array_sort(F.collect_set(col)), sep)
