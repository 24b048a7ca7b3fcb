"""Names, lines and labels as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(line: Column) -> Column:
    """The runs of other than white space in a line."""
    return F.filter(F.split(line, r"\s+"), lambda x: x != "")


def is_comment(line: Column, prefixes: tuple[str, ...]) -> Column:
    """Whether a line begins, before any trimming, with one of ``prefixes``."""
    out = F.lit(False)
    for prefix in prefixes:
        out = out | line.startswith(prefix)
    return out


def is_blank(line: Column, comment: str = "") -> Column:
    """Whether a line has no token, or one that begins with ``comment`` comes first."""
    return line.rlike(rf"\A\s*+({re.escape(comment)}|\z)" if comment else r"\A\s*+\z")


def mission_code(name: Column) -> Column:
    """The part before the first underscore, in capitals."""
    return F.upper(F.substring_index(name, "_", 1))


def archive_code(name: Column) -> Column:
    """HASDM_ and the year of the first six-digit year and month in a name; raises if there is none."""
    year = F.regexp_extract(name, r"(\d{4})\d{2}", 1)
    return F.when(year != "", F.concat(F.lit("HASDM_"), year)).otherwise(F.raise_error(F.concat(F.lit("no year and month in "), name)).cast("string"))


def strip_suffix(name: Column, suffix: str) -> Column:
    return F.when(name.endswith(suffix), F.substring(name, F.lit(1), F.length(name) - len(suffix))).otherwise(name)


def renamed(name: Column, old: str, new: str) -> Column:
    return F.replace(name, F.lit(old), F.lit(new))


def url_tail(url: Column) -> Column:
    """What follows the last slash of an address, slashes at its end aside; download.bin if that is nothing."""
    tail = F.substring_index(F.regexp_replace(url, "/+$", ""), "/", -1)
    return F.coalesce(F.nullif(tail, F.lit("")), F.lit("download.bin"))


def year_month(name: Column) -> Column:
    """year * 100 + month from _YYYY_MM_ or else _YYYY-MM. in a name; null if it has neither."""

    def found(pattern: str) -> Column:
        digits = F.concat(F.regexp_extract(name, pattern, 1), F.regexp_extract(name, pattern, 2))
        return F.nullif(digits, F.lit("")).cast("int")

    return F.coalesce(found(r"_(\d{4})_(\d{2})_"), found(r"_(\d{4})-(\d{2})\."))


def in_months(name: Column, start: int | None, end: int | None) -> Column:
    """Whether a name's month is in the range (ends included, as year * 100 + month); names without one pass."""
    ym, inside = year_month(name), F.lit(True)
    if start is not None:
        inside = inside & (ym >= start)
    if end is not None:
        inside = inside & (ym <= end)
    return ym.isNull() | inside


def answer_parts(line: Column) -> Column:
    """The code, content type and address in what a fetch reports of its answer, as up to three strings."""
    return F.split(F.regexp_replace(line, r"^\s+", ""), r"\s+", 3)


def shortened(error: Column, most: int = 240) -> Column:
    return F.substring(error, 1, most)


def relative(path: Column, root: str) -> Column:
    """A path below ``root`` without it; any other path as it is."""
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, F.lit(len(prefix) + 1), F.length(path))).otherwise(path)


def row_label(name: Column, low_m: Column, high_m: Column, first: Column, last: Column) -> Column:
    """A figure's row label: the name, and unless it tells them the altitudes in km and the years."""
    made = F.format_string("%s %.0f-%.0f km, %d-%d", name, low_m / 1000.0, high_m / 1000.0, F.year(first), F.year(last))
    return F.when(F.contains(name, F.lit(" km,")), name).otherwise(made)


def panel_letter(row: Column, column: Column, columns: int = 3) -> Column:
    return F.char((row * columns + column + ord("a")).cast("int"))


def has_component(path: Column, names: list[str]) -> Column:
    """Whether a component of a path, whole, is one of ``names``."""
    return F.arrays_overlap(F.split(path, "[/\\\\]"), F.array(*[F.lit(n) for n in names]))
