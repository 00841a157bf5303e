"""Small value and text expressions shared by every layer of the package."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class labels of the six-level urban-rural county scheme.
URBAN_RURAL_LABELS = {
    1: "Large central metro",
    2: "Large fringe metro",
    3: "Medium metro",
    4: "Small metro",
    5: "Micropolitan",
    6: "Noncore (nonmetro)",
}


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def number(value: Column | str) -> Column:
    """Double with NaN turned into NULL, so comparisons treat "missing" one way only."""
    return F.nanvl(as_column(value).cast("double"), F.lit(None).cast("double"))


def strip_suffix(value: Column | str, suffix: str) -> Column:
    value = as_column(value)
    stem = value.substr(F.lit(1), F.length(value) - len(suffix))
    return F.when(value.endswith(suffix), stem).otherwise(value)


def normalise(value: Column | str) -> Column:
    """Case- and whitespace-insensitive form used for near-miss matching."""
    return F.lower(F.trim(as_column(value)))


def county_of(zone_id: Column | str) -> Column:
    """First five digits of a zone key; a shorter key is an error, never a short result."""
    key = as_column(zone_id)
    too_short = F.raise_error(F.concat(F.lit("zone key shorter than 5 characters: "), key))
    return F.when(F.length(key) < 5, too_short).otherwise(F.substring(key, 1, 5))


def county_key(state: Column | str, county: Column | str) -> Column:
    """Zero-padded 2+3 digit key from parts that may arrive as 4, 4.0, "4" or "04"."""

    def digits(part: Column | str, width: int) -> Column:
        whole = as_column(part).cast("double").cast("int").cast("string")
        return F.lpad(whole, width, "0")

    return F.concat(digits(state, 2), digits(county, 3))


def label_of(code: Column | str, labels: Mapping[int, str]) -> Column:
    """Code -> label; an unknown code gives NULL."""
    pairs = [F.lit(x) for item in labels.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), as_column(code).cast("int"))


def parse_tags(cell: Column | str, separator: str = "; ") -> Column:
    """Delimited text back to an array; NULL and blank both mean "no tags"."""
    cell = as_column(cell)
    empty = F.array().cast("array<string>")
    return F.when(cell.isNull() | (cell == ""), empty).otherwise(F.split(cell, separator, -1))


def has_tag(cell: Column | str, tag: str) -> Column:
    """Exact tag membership; a substring of a longer tag does not count."""
    return F.array_contains(parse_tags(cell), tag)


def matches_any_word(value: Column | str, words: Sequence[str]) -> Column:
    """Case-insensitive "contains any of these words"; NULL input counts as no match."""
    quoted = ["\\Q" + word.replace("\\E", "\\E\\\\E\\Q") + "\\E" for word in words]
    pattern = "(?iu)" + "|".join(quoted)
    return F.coalesce(as_column(value).rlike(pattern), F.lit(False))


def digits_only(value: Column | str, length: int) -> Column:
    return as_column(value).rlike(f"^[0-9]{{{length}}}$")


def unit_interval(value: Column | str, placeholder: float | None = None) -> Column:
    value = as_column(value)
    inside = value.between(0.0, 1.0)
    return inside if placeholder is None else inside | (value == F.lit(placeholder))


def count_where(condition: Column) -> Column:
    """Rows where the condition is true (NULL is not true), as a bigint."""
    return F.count_if(F.coalesce(condition, F.lit(False)))


def null_rate(column: Column | str) -> Column:
    """Share of NULLs; NULL itself on an empty input."""
    return F.avg(as_column(column).isNull().cast("double"))


def one_of(conditions: Sequence[tuple[Column, Column | str]], default: Column | None) -> Column:
    """First matching branch of an ordered rule list."""
    chain = reduce(
        lambda acc, pair: acc.when(pair[0], pair[1]),
        conditions[1:],
        F.when(conditions[0][0], conditions[0][1]),
    )
    return chain if default is None else chain.otherwise(default)
