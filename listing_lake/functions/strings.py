"""Scalar functions on text, maps and nested values: Column -> Column, built-in expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import col, strip


def lower(x: Column | str) -> Column:
    """C2"""
    return F.lower(col(x).cast("string"))


def place_name(x: Column | str) -> Column:
    """A province or region name as a key: lower case, spaces to hyphens, NULL to the empty text."""
    return F.coalesce(F.replace(F.lower(col(x)), F.lit(" "), F.lit("-")), F.lit(""))


def before_separator(x: Column | str, separator: str = "|") -> Column:
    """C4: the part before the first separator, stripped; NULL to the empty text."""
    return F.coalesce(strip(F.split_part(col(x), F.lit(separator), F.lit(1))), F.lit(""))


def truncated(x: Column | str, n: int, suffix: str = "...") -> Column:
    """At most n characters, the suffix of a cut text included."""
    x = col(x)
    return F.when(F.char_length(x) <= n, x).otherwise(F.concat(F.left(x, F.lit(max(n - len(suffix), 0))), F.lit(suffix[:n])))


def spaced(x: Column | str) -> Column:
    """Text made ready for translation: underscores to spaces, a space after punctuation before a letter, spaces
    around slashes and hyphens between letters (dates and ranges stay), single spaces."""
    x = F.regexp_replace(col(x), "_+", " ")
    x = F.regexp_replace(x, "([.,;:])(?=[A-Za-z])", "$1 ")
    for mark in "/-":
        x = F.regexp_replace(x, f"(?<=[A-Za-z]){mark}(?=[A-Za-z])", f" {mark} ")
    return strip(F.regexp_replace(x, " +", " "))


def cleaned(x: Column | str) -> Column:
    """White space collapsed and stripped."""
    return strip(F.regexp_replace(col(x), r"\s+", " "))


def nested(x: Column | str, *path: str, default: str | None = None) -> Column:
    """A value of JSON text by its path, or the default."""
    found = F.try_variant_get(F.try_parse_json(col(x)), "$" + "".join(f".{p}" for p in path), "string")
    return found if default is None else F.coalesce(found, F.lit(default))


def merged_maps(*maps: Column) -> Column:
    """One map of several; of a key's values the last one's stays."""

    def two(a: Column, b: Column) -> Column:
        return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)

    return reduce(two, maps)


def long_key(x: Column | str) -> Column:
    """The digest that stands for a long text in a key."""
    return F.sha2(col(x), 256)


def short_digest(x: Column | str) -> Column:
    """C33, short form: the first 16 digits of the MD5."""
    return F.left(F.md5(col(x)), F.lit(16))


def all_null(*columns: Column | str) -> Column:
    """C34"""
    return reduce(lambda a, b: a & b, (col(c).isNull() for c in columns))


def looked_up(x: Column | str, mapping: dict[str, object], default: Column | None = None) -> Column:
    """The value of a fixed mapping; what isn't in it gets the default (NULL if there is none)."""
    table = F.create_map(*(F.lit(v) for pair in mapping.items() for v in pair))
    found = F.try_element_at(table, col(x))
    return found if default is None else F.coalesce(found, default)
