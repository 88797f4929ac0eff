"""Titles and numbers, as column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_upper(col: Column) -> Column:
    """The first letter in upper case, as titles are looked up."""
    return F.concat(F.upper(F.substring(col, 1, 1)), col.substr(F.lit(2), F.length(col)))


def normalize_casing(col: Column) -> Column:
    """The first letter of each word in upper case, the rest as it is."""
    parts = F.regexp_extract_all(col, F.lit(r"((?U)\w+|(?U)\W+)"), F.lit(1))
    return F.array_join(F.transform(parts, first_upper), "")


def clean_title(col: Column) -> Column:
    """Underscores to spaces, runs of spaces to one, without the part after a number sign, trimmed."""
    s = F.regexp_replace(F.trim(col), "_+", " ")
    s = F.regexp_replace(s, r"\s+", " ")
    return F.trim(F.regexp_replace(s, "#.*$", ""))


def title_scope(col: Column) -> Column:
    """What stands in the last brackets at the end of a title, null if there are none."""
    s = F.trim(F.regexp_extract(col, r"^(.+)\(([^()]*)\)\s*$", 2))
    return F.when(s != "", s)


def title_without_scope(col: Column) -> Column:
    """The title before the last brackets at its end."""
    return F.trim(F.regexp_replace(col, r"(.)\([^()]*\)\s*$", "$1"))


def link_parts(col: Column) -> tuple[Column, Column]:
    """(destination, text) of the inside of a link: the destination before the first bar, the text after the last."""
    dest = F.trim(F.regexp_extract(col, r"^([^|]*)", 1))
    text = F.when(col.contains("|"), F.regexp_extract(col, r"([^|]*)$", 1)).otherwise(col)
    return dest, text


def escape_text(col: Column) -> Column:
    """Backslash, double quote and line end escaped by a backslash, ends trimmed."""
    s = F.replace(col, F.lit("\\"), F.lit("\\\\"))
    s = F.replace(s, F.lit('"'), F.lit('\\"'))
    return F.trim(F.replace(s, F.lit("\n"), F.lit("\\n")))


def unescape_text(col: Column) -> Column:
    """The reverse of escape_text."""
    s = F.replace(col, F.lit("\\\\"), F.lit("\x00"))
    s = F.replace(F.replace(s, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n"))
    return F.replace(s, F.lit("\x00"), F.lit("\\"))


def is_date_title(col: Column) -> Column:
    """Whether a title is a month and a day."""
    months = "january|february|march|april|may|june|july|august|september|october|november|december"
    return col.rlike(rf"(?i)^({months})\s+\d+")


def six_digits(col: Column) -> Column:
    """A measure with six digits, half to even."""
    return F.format_string("%.6f", F.bround(col, 6))


def percent(col: Column) -> Column:
    """A share as a percentage with two digits."""
    return F.concat(F.format_string("%.2f", F.bround(col * 100, 2)), F.lit("%"))


def argument(col: Column, kind: str, default: object) -> Column:
    """A text argument as `kind`, or the default where it is missing or not of the kind."""
    return F.coalesce(col.try_cast(kind), F.lit(default).cast(kind))


def source_mode(col: Column) -> Column:
    """'url' for an address, 'html' if there are more tags than wiki links, else 'wiki'."""
    tags = F.size(F.regexp_extract_all(col, F.lit(r"(<[^<>]*>)"), F.lit(1)))
    links = F.size(F.regexp_extract_all(col, F.lit(r"(\[\[[^\[\]]*\]\])"), F.lit(1)))
    return F.when(col.rlike(r"^\s*(www\.|https?://)"), "url").when(tags > links, "html").otherwise("wiki")
