"""Names, paths and numbers in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gustframe.functions.nulls import col


def station_id(c: Column | str, width: int = 5) -> Column:
    """Zero-padded; longer ids stay whole."""
    s = col(c).cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def part(c: Column | str, delimiters: str, index: int) -> Column:
    """The index-th piece (negative: from the end) between delimiters, a set of characters; null if there are too few."""
    return F.try_element_at(F.split(col(c), f"[{delimiters}]"), F.lit(index))


def found(c: Column | str, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null without one."""
    return F.nullif(F.regexp_extract(col(c), pattern, group), F.lit(""))


def slug(c: Column | str) -> Column:
    """Lower case, other characters as single hyphens, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-"), "^-|-$", "")


def decimal_comma(c: Column | str) -> Column:
    """A number with decimal comma or point, null for other text."""
    return F.regexp_replace(F.trim(col(c)), ",", ".").try_cast("double")


def grid_point(c: Column | str) -> tuple[Column, Column]:
    """Latitude and longitude of a file name DD_DDDD_DD_DDDD..., null if it isn't one."""
    p = F.split(F.regexp_replace(col(c), r"^.*/|\.[^.]*$", ""), "_")

    def number(i: int) -> Column:
        whole, rest = (F.try_element_at(p, F.lit(k)) for k in (i, i + 1))
        return F.when(F.size(p) >= 4, whole.try_cast("int") + rest.try_cast("int") / F.lit(10_000.0))

    lat, lon = number(1), number(3)
    good = lat.isNotNull() & lon.isNotNull()
    return F.when(good, lat), F.when(good, lon)


def integral(c: Column | str) -> Column:
    """A number that was read as a float, as text without decimals."""
    return col(c).cast("bigint").cast("string")


def number_or_text(c: Column | str, names: dict[int, str], default: str = "Other") -> Column:
    """Codes become names, text stays."""
    from gustframe.functions.nulls import mapped

    code = col(c).try_cast("int")
    return F.when(code.isNotNull(), mapped(code, names, default)).otherwise(col(c))


def chart_object(c: Column | str, schema: str, start: str = "{") -> Column:
    """The object in a page's script, with unquoted names and single quotes allowed, read by schema."""
    body = F.regexp_extract(col(c), r"(?s)(\{.*\})", 1)
    return F.from_json(body, schema, {"allowUnquotedFieldNames": "true", "allowSingleQuotes": "true"})


def path_order(c: Column | str) -> Column:
    """The number at the end of a file's name, for sorting; files without one come last."""
    return F.coalesce(found(c, r"_(\d+)\.[A-Za-z0-9]+$").cast("int"), F.lit(2**31 - 1))
