"""Match keys, indicator flags and the strings that encode a predicate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Occupancy codes that count as non-residential.
NON_RESIDENTIAL = (4, 6, 17, 18, 19)


def _fixed(x: Column, places: int) -> Column:
    return F.call_function("format_number", x, F.lit("0." + "0" * places))


def tenth_key(x: Column) -> Column:
    """x to one decimal as text, rounding the binary value (35.05 gives 35.0)."""
    return _fixed(x, 1)


def coordinate_key(x: Column, y: Column, places: int = 6) -> Column:
    return F.concat(F.lit("("), _fixed(x, places), F.lit(","), _fixed(y, places), F.lit(")"))


def cell_key(lat: Column, lon: Column) -> Column:
    """Name of the 0.1 degree cell of a point."""
    return F.concat(F.lit("("), tenth_key(lat), F.lit(","), tenth_key(lon), F.lit(")"))


def zone_flag(zone: Column, letters: str = "AV") -> Column:
    """1 if a zone starts with one of the letters, in either case; null gives 0."""
    return F.coalesce(F.upper(zone).rlike(f"^[{letters}]"), F.lit(False)).cast("int")


def coastal_flag(zone: Column) -> Column:
    return zone_flag(zone, "V")


def occupancy_class(code: Column) -> Column:
    """NR for the non-residential codes, R for all others and for null."""
    return F.when(code.isin(*NON_RESIDENTIAL), "NR").otherwise("R")


def building_class(name: Column) -> Column:
    return F.when(name == "Residential", "R").otherwise("NR")


def any_is(values: Column, value: str) -> Column:
    return F.coalesce(F.array_contains(values, value), F.lit(False)).cast("int")


def any_starts(values: Column, prefix: str) -> Column:
    return F.coalesce(F.exists(values, lambda z: F.upper(z).startswith(prefix)), F.lit(False)).cast("int")


def distinct_values(*columns: Column) -> Column:
    """The distinct non-null values of several columns, sorted; null if there are none."""
    values = F.array_sort(F.array_distinct(F.array_compact(F.array(*columns))))
    return F.when(F.size(values) > 0, values)


def empty_to_null(values: Column) -> Column:
    return F.when(F.size(F.array_compact(values)) > 0, values)


def null_safe_false(a: Column, b: Column) -> Column:
    """a = b, false if either is null."""
    return F.coalesce(a == b, F.lit(False))


def namespaced(prefix: Column, key: Column) -> Column:
    return F.concat_ws("_", prefix, key)


def key_part(match_key: Column, name: str) -> Column:
    """The value that a match key has for an attribute; null if it has none."""
    got = F.regexp_extract(match_key, rf"\({name}==([^)]*)\)", 1)
    return F.when(got != "", got)


def naive(ts: Column) -> Column:
    """A timestamp as it is written: an offset or Z at its end is dropped, not applied."""
    return F.to_timestamp_ntz(F.regexp_replace(ts.cast("string"), r"(Z|[+-]\d\d:?\d\d)$", ""))


def recode(x: Column, rules: dict[int, int]) -> Column:
    """All rules at once, judged on the original value."""
    pairs = [F.lit(v) for kv in rules.items() for v in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), x), x)


def harmonized(df: DataFrame, floats: bool = False) -> DataFrame:
    """All integers as long; floats as double, or as float for a sink."""
    kinds = {"tinyint": "long", "smallint": "long", "int": "long", "float": "float" if floats else "double", "double": "float" if floats else "double"}
    return df.select(*[F.col(f"`{n}`").cast(kinds.get(t, t)).alias(n) for n, t in df.dtypes])
