"""Column helpers: finite masks, guarded ratios, timestamps, path segments."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Denominators this near to zero give no ratio.
EPS = 1e-12


def finite(x: Column) -> Column:
    """Whether x is neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def only_finite(x: Column) -> Column:
    return F.when(finite(x), x)


def ratio(numerator: Column, denominator: Column, eps: float = EPS) -> Column:
    """numerator / denominator, null where the denominator is within eps of zero or the result isn't finite."""
    return only_finite(F.when(F.abs(denominator) > eps, numerator / denominator))


def relative_change(first: Column, latest: Column) -> Column:
    """Signed movement from first to latest in units of |first|."""
    return ratio(latest - first, F.abs(first))


def iso_utc(ts: Column) -> Column:
    """ISO-8601 with Z; the fraction only where there is one. The session's time zone must be UTC."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(whole, F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""), F.lit("Z"))


def path_segment(name: Column) -> Column:
    """A name as one segment of a dashboard path; the empty name is @root."""
    quoted = F.replace(F.replace(F.replace(F.url_encode(name), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.when(name == "", F.lit("@root")).otherwise(quoted)


def tensor_prefix(module: Column, call_index: Column, tensor_path: Column) -> Column:
    return F.concat(F.lit("modules/"), path_segment(module), F.lit("/call_"), call_index.cast("string"), F.lit("/"), path_segment(tensor_path))


def clean_prefix(prefix: str) -> str:
    """A metric prefix without blanks and slashes around it; empty ones are refused."""
    found = prefix.strip().strip("/")
    if not found:
        raise ValueError("the metric prefix must not be empty")
    return found


def truncated(text: Column, limit: int) -> Column:
    """At most limit characters; what is cut ends in an ellipsis."""
    return F.when(F.char_length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(text)


def next_double(x: float, toward: float) -> float:
    return math.nextafter(x, toward)


def linspace(lo: Column, hi: Column, bins: int) -> Column:
    """bins + 1 equally spaced edges."""
    return F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: F.when(i == bins, hi).otherwise(lo + i.cast("double") * (hi - lo) / F.lit(float(bins))))


def quantile_of_sorted(values: Column, q: float) -> Column:
    """Linearly interpolated quantile of a sorted array; null if it is empty."""
    place = (F.size(values) - 1).cast("double") * F.lit(q)
    low = F.floor(place).cast("int")
    a, b = F.get(values, low), F.get(values, F.least(low + 1, F.size(values) - 1))
    return a + (b - a) * (place - low)
