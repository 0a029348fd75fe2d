"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spendloom.config import ID_PREFIXES

#: Every kind of white space: ASCII, the separators 1C to 1F, next line, and Unicode spaces.
_WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    chr(n) for n in range(0x2000, 0x200B)
)


def trimmed(c: Column) -> Column:
    """Trim every kind of whitespace; Spark's `trim` takes spaces only."""
    return F.btrim(c, F.lit(_WHITESPACE))


def normalised(c: Column) -> Column:
    return F.lower(trimmed(c))


def non_blank(c: Column) -> Column:
    """Trimmed text, NULL when nothing is left."""
    return F.nullif(trimmed(c), F.lit(""))


def in_scope(c: Column, values: tuple[str, ...] | list[str]) -> Column:
    return normalised(c).isin(*values)


def equals_normalised(c: Column, value: str) -> Column:
    return normalised(c) == value.strip().lower()


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """First match of a non-empty group, NULL (not '') without a match."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def class_code(c: Column) -> Column:
    """Leading digits of a class text such as ' 54 - Fasteners'."""
    return extract(c, r"^\s*(\d+)")


def looks_latin(c: Column) -> Column:
    """Only Latin letters, digits and common punctuation."""
    return c.rlike(r"^[A-Za-z0-9 ,./()%+-]+$")


def attribute_key(c: Column) -> Column:
    """Attribute id without 'ta' in front and without a numeric or empty suffix."""
    for pattern in (r"^ta", r"_[0-9]+$", r"_$"):
        c = F.regexp_replace(c, pattern, "")
    return c


def strip_id_prefix(c: Column) -> Column:
    prefixes = "|".join(p for p in ID_PREFIXES if p)
    return F.regexp_replace(c, f"^({prefixes})", "")


def merge_text(a: Column, b: Column, separator: str = " | ") -> Column:
    """Both texts when they differ, else the one present."""
    return F.when(a != b, F.concat(a, F.lit(separator), b)).otherwise(F.coalesce(a, b))


def group_of(c: Column, groups: dict[str, tuple[str, ...]]) -> Column:
    """Name of the group listing the value, NULL when none does."""
    group_of_value = [F.lit(text) for name, members in groups.items() for m in members for text in (m, name)]
    return F.try_element_at(F.create_map(*group_of_value), c)


def safe_slug(c: Column) -> Column:
    """Text usable as a file name: no path characters, no blanks, single '_'."""
    c = F.regexp_replace(c.cast("string"), r'[\\/:*?"<>|]', "_")
    c = F.regexp_replace(c, r"(?U)\s+", "_")
    return F.btrim(F.regexp_replace(c, "_+", "_"), F.lit("_"))


def amount_text(c: Column, unit: str = "EUR") -> Column:
    """'1,234.50 EUR'; what is not a number gives 'Invalid value'."""
    text = F.concat(F.format_number(c, 2), F.lit(f" {unit}"))
    return F.coalesce(text, F.lit("Invalid value"))


def with_suffix(c: Column, unit: str = "EUR") -> Column:
    return F.concat(c.cast("string"), F.lit(f" {unit}"))


def parse_amount(c: Column, unit: str = "EUR") -> Column:
    """Number in an amount text, NULL when it holds none."""
    number = trimmed(F.replace(F.replace(c, F.lit(f" {unit}"), F.lit("")), F.lit(","), F.lit("")))
    numeric = number.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$")
    return F.when(numeric, number.try_cast("double"))


def is_valid_amount(c: Column, unit: str = "EUR") -> Column:
    """Grouped by thousands, two decimals or none, no sign, with the unit."""
    return c.rlike(rf"^\d{{1,3}}(,\d{{3}})*(\.\d{{2}})? {unit}$")
