"""String helpers of the file layer as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokenize(s: Column, delimiter: str = " ") -> Column:
    """Parts between delimiters, empty ones skipped."""
    return F.array_remove(F.split(s, f"\\Q{delimiter}\\E"), "")


def last_segment(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def base_name(path: Column) -> Column:
    """Last segment without its extension."""
    return F.regexp_replace(last_segment(path), r"\.[^.]*$", "")


def user_and_id(base: Column) -> tuple[Column, Column]:
    """Parts before and after the first underscore."""
    return F.substring_index(base, "_", 1), F.regexp_extract(base, r"^[^_]*_(.*)$", 1)


def key_path(path: Column) -> Column:
    return F.regexp_replace(path, r"(?i)\.jpe?g$", ".key")


def pad4(n: Column) -> Column:
    """At least four digits; longer numbers stay as they are."""
    return F.lpad(n.cast("string"), F.greatest(F.lit(4), F.length(n.cast("string"))), F.lit("0"))


def option_value(s: Column) -> tuple[Column, Column]:
    """Name and value of --name=value; the value is null without an equals sign, all null for what is no option."""
    good = F.trim(s).rlike(r"^--?[A-Za-z][A-Za-z0-9_-]*(=.*)?$")
    bare = F.regexp_replace(F.trim(s), "^--?", "")
    return F.when(good, F.substring_index(bare, "=", 1)), F.when(good & bare.contains("="), F.trim(F.regexp_replace(bare, "^[^=]*=", "")))


def unknown_option(name: Column, known: list[str]) -> Column:
    """Whether a name is none of the known options."""
    return name.isNull() | ~name.isin(*known)


def expand_ranges(s: Column) -> Column:
    """Numbers of a list such as 1,3-5,25-20 (ranges run both ways); null if a part is no range."""
    parts = F.transform(F.split(s, ","), lambda p: F.trim(p))
    good = F.forall(parts, lambda p: p.rlike(r"^\d+(-\d+)?$"))
    end = lambda p: F.element_at(F.split(p, "-"), -1).cast("long")
    return F.when(good, F.flatten(F.transform(parts, lambda p: F.sequence(F.element_at(F.split(p, "-"), 1).cast("long"), end(p)))))
