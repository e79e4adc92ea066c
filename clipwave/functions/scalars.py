"""Column expressions that many operators use.

Missing values are NULL, never NaN (``clean`` converts at ingestion), so aggregates skip
them; conditions that feed a boolean go through ``true_if``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the smallest difference from 1 of a double; guards denominators.
EPS = 2.220446049250313e-16


def clean(c: Column) -> Column:
    """NaN becomes NULL."""
    return F.when(~F.isnan(c), c)


def true_if(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def energy_ratio(power: Column, baseline: Column) -> Column:
    """power / baseline with the limits of the streaming detector: positive over nothing is infinite, nothing over nothing is missing."""
    return F.when((baseline == 0) & (power > 0), F.lit(float("inf"))).when(baseline == 0, F.lit(None)).otherwise(power / baseline)


def rounded(c: Column | str, digits: int) -> Column:
    """A double rounded as SQL's engine does it: times the power of ten, to the nearest whole number (halves away from zero), divided again. ``F.round`` rounds the decimal text instead, which gives other values near halves."""
    c, scale = F.col(c) if isinstance(c, str) else c, F.lit(10.0**digits)
    return F.when(F.abs(c * scale) < float("inf"), F.round(c * scale) / scale).otherwise(c)


def hazen(values: Column, p: float) -> Column:
    """Quantile with plotting position (k - 0.5) / n of an array; null if it is empty."""
    s, n = F.array_sort(F.filter(values, lambda x: x.isNotNull())), F.size(F.filter(values, lambda x: x.isNotNull()))
    at = F.greatest(F.lit(1.0), F.least(n.cast("double"), p * n + F.lit(0.5)))
    low = F.try_element_at(s, F.floor(at).cast("int"))
    high = F.try_element_at(s, F.least(n, F.floor(at).cast("int") + 1))
    return F.when(n > 0, low + (high - low) * (at - F.floor(at)))


# Labels


def normalize_label(c: Column) -> Column:
    """One zero right before the contact's number goes: LA01 is LA1."""
    return F.regexp_replace(c, "^([^0-9]*)0", "$1")


def electrode(c: Column) -> Column:
    return F.regexp_extract(c, "([A-Za-z]+)([0-9]+)", 1)


def contact(c: Column) -> Column:
    return F.regexp_extract(c, "([A-Za-z]+)([0-9]+)", 2).try_cast("int")


def pair_string(a: Column, b: Column) -> Column:
    """Both labels in lexicographic order, joined by a hyphen; a missing one is left out."""
    return F.when(a.isNotNull() & b.isNotNull(), F.concat(F.least(a, b), F.lit("-"), F.greatest(a, b))).otherwise(F.coalesce(a, b, F.lit("")))


def group_id(c: Column, pattern: str) -> Column:
    """First match of the pattern, else the whole name."""
    return F.coalesce(F.nullif(F.regexp_extract(c, f"({pattern})", 1), F.lit("")), c)


def session_tag(name: Column, modifier: Column) -> Column:
    return F.concat_ws("_", name, modifier.cast("string"))


def session_of_clip(clip: Column) -> Column:
    """A clip's name without its event part."""
    return F.regexp_replace(clip, "_ev[0-9]+.*$", "")


def clip_name(tag: Column, event: Column, pair: Column) -> Column:
    """tag_evNN_pair without anything but word characters and hyphens."""
    return F.regexp_replace(F.concat(tag, F.lit("_ev"), F.lpad(event.cast("string"), 2, "0"), F.lit("_"), pair), r"[^\w-]", "")


def relay_channels(c: Column) -> tuple[Column, Column]:
    """The two channels that an annotation's relay text names; null where it names none."""
    pattern = r"Closed relay to ([A-Za-z]+[0-9]+) and ([A-Za-z]+[0-9]+)"
    return tuple(normalize_label(F.nullif(F.regexp_extract(c, pattern, k), F.lit(""))) for k in (1, 2))
