"""Normalised values, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of any kind (the Unicode property White_Space), as a fixed value.
WHITE_SPACE = "\t\n\u000b\f\r \u0085                 　"


def strip(value: Column) -> Column:
    """Without surrounding white space of any kind."""
    return F.btrim(value, F.lit(WHITE_SPACE))


def normalised(value: Column) -> Column:
    """Without surrounding white space and in lower case; null stays null."""
    return F.lower(strip(value))


def normalised_set(values: Column) -> Column:
    """The distinct normalised non-empty entries, sorted; null stays null."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(values, normalised), lambda x: x != "")))


def number_text(value: Column) -> Column:
    """Number text in one spelling ('8.00' and ' 8' give '8.0'); other text is normalised."""
    text = normalised(value)
    return F.coalesce(text.try_cast("double").cast("string"), text)


def canonical(value: Column, kind: T.DataType) -> Column:
    """A value whose equality is: text normalised, lists as sets, structs as a whole, null equal only to null."""
    if isinstance(kind, T.StringType):
        return normalised(value)
    if isinstance(kind, T.ArrayType):
        return F.array_sort(F.array_distinct(F.transform(value, lambda x: canonical(x, kind.elementType))))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(canonical(value[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    return value


def canonical_text(value: Column, kind: T.DataType) -> Column:
    """``canonical`` as a string, so that values of every type can be hashed alike."""
    if isinstance(kind, (T.ArrayType, T.StructType)):
        wrapped = F.struct(canonical(value, kind).alias("v"))
        return F.when(value.isNotNull(), F.to_json(wrapped, {"ignoreNullFields": "false"}))
    return canonical(value, kind).cast("string")
