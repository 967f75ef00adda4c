"""Similarities and scalar functions, as Column expressions in [0, 1] unless said otherwise.

A SQL null stands for an absent value. All are evaluated in the JVM.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kenmark.functions.text import strip

DAY_MS = 24 * 60 * 60 * 1000
DECAY_TAU_MS = 30 * DAY_MS


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def score(x: Column) -> Column:
    """An integer from 0 to 100."""
    return round_half_up(F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))).cast("int")


def total(columns: list[Column]) -> Column:
    return reduce(Column.__add__, columns)


def present(value: Column, kind: T.DataType) -> Column:
    """Not null, not blank text and not an empty list."""
    if isinstance(kind, T.StringType):
        return F.coalesce(F.length(strip(value)) > 0, F.lit(False))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.size(value) > 0, F.lit(False))
    return value.isNotNull()


def positional_similarity(a: Column, b: Column) -> Column:
    """1 less the share of places at which two texts differ, missing places included."""
    mismatched = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x == y) & x.isNotNull() & y.isNotNull()), lambda same: same))
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1 - (longest - mismatched) / longest)


def folded_similarity(a: Column, b: Column) -> Column:
    """``positional_similarity`` in lower case; an absent text is empty."""
    return positional_similarity(F.lower(F.coalesce(a, F.lit(""))), F.lower(F.coalesce(b, F.lit(""))))


def same_text(a: Column, b: Column) -> Column:
    """Equality of digests; an absent one is empty."""
    return (F.coalesce(a, F.lit("")) == F.coalesce(b, F.lit(""))).cast("double")


def exact(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), 0.5).otherwise((a == b).cast("double"))


def jaccard(a: Column, b: Column, kind: T.ArrayType) -> Column:
    """Of two lists as sets, elements compared as a whole; two empty lists are the same."""
    empty = F.array().cast(kind)
    x, y = F.coalesce(a, empty), F.coalesce(b, empty)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def numeric_proximity(a: Column, b: Column) -> Column:
    gap = F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1))
    return F.when(a.isNull() | b.isNull(), 0.5).when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - gap))


def screen_similarity(a: Column, b: Column) -> Column:
    """Mean of the sizes' and depths' proximities and of the orientations' equality."""
    near = [numeric_proximity(a[x].cast("double"), b[x].cast("double")) for x in ("width", "height", "colorDepth", "pixelDepth")]
    turned = exact(a["orientation"]["type"], b["orientation"]["type"])
    return F.when(a.isNull() | b.isNull(), 0.5).otherwise(total([*near, turned]) / 5)


def decay(age_ms: Column, tau_ms: float = DECAY_TAU_MS) -> Column:
    """exp(-age/tau), and 1 for an age of 0 or less."""
    return F.when(age_ms <= 0, 1.0).otherwise(F.exp(-age_ms / F.lit(float(tau_ms))))


def age_ms(later: Column, earlier: Column) -> Column:
    return F.unix_millis(later) - F.unix_millis(earlier)


def subnet(ip: Column) -> Column:
    """The first three numbers of a dotted address, else null."""
    found = F.regexp_extract(ip, r"^(\d+\.\d+\.\d+)\.\d+$", 1)
    return F.when(found != "", found)


def canonical_string(value: Column, kind: T.DataType) -> Column:
    """One text per value: members in the order of their names, absent ones left out, lists in order."""
    if isinstance(kind, T.StructType):
        members = [F.concat(F.lit(f"{f.name}:"), canonical_string(value[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(value.isNotNull(), F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}")))
    if isinstance(kind, T.ArrayType):
        parts = F.transform(value, lambda x: F.coalesce(canonical_string(x, kind.elementType), F.lit("")))
        return F.when(value.isNotNull(), F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]")))
    return value.cast("string")


def is_finite_positive(x: float) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x) and x >= 0
