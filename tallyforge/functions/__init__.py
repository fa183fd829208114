"""Column expressions with pinned null semantics; all stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_to(column: Column, multiple: int | None) -> Column:
    """Nearest multiple, halves up, as bigint; null stays null; ``None`` and 1 change nothing."""
    if not multiple or multiple == 1:
        return column
    whole = F.lit(int(multiple)).cast("bigint")
    return (column + F.lit(multiple // 2)) - F.pmod(column + F.lit(multiple // 2), whole)


def only_if(test: Column, column: Column) -> Column:
    """The value where the test is true, else null."""
    return F.when(test, column)


def part(column: Column, index: int) -> Column:
    """Element of an array, null out of bounds (also under ANSI)."""
    return F.get(column, F.lit(index))


def split_on(column: Column, literal: str) -> Column:
    """Split at a literal, trailing empties kept."""
    return F.split(column, re.escape(literal), -1)


def reference_parts(reference: Column) -> Column:
    """``V//C`` or, without a double slash, ``V/C`` into its parts."""
    return F.when(F.contains(reference, F.lit("//")), split_on(reference, "//")).otherwise(split_on(reference, "/"))


def full_code(vocabulary: Column, code: Column) -> Column:
    """``vocabulary//code``; null if either is null."""
    return F.concat(vocabulary, F.lit("//"), code)


def double_slash(reference: Column) -> Column:
    """``V/C`` with exactly one slash becomes ``V//C``; anything else stays."""
    slashes = F.length(reference) - F.length(F.replace(reference, F.lit("/"), F.lit("")))
    return F.when(slashes == 1, F.replace(reference, F.lit("/"), F.lit("//"))).otherwise(reference)


def without_first(items: Column) -> Column:
    """List without its first element (``slice`` with a huge length would overflow to nothing)."""
    return F.when(F.size(items) > 1, F.slice(items, F.lit(2), F.size(items))).when(
        items.isNotNull(), F.array().cast("array<string>")
    )


def merge_lists(first: Column, second: Column) -> Column:
    """Both lists in order, each value once (one null at most); a null list counts as empty."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(first, empty), F.coalesce(second, empty)))


def non_empty(items: Column) -> Column:
    return F.when(F.size(items) > 0, items)


def is_blank(column: Column) -> Column:
    """Null or nothing but white space."""
    return column.isNull() | (F.trim(column) == "")


def split_suffix(split: Column) -> Column:
    """The suffix of ``split_column_names`` as an expression; null for a null split."""
    words = F.lower(F.trim(F.regexp_replace(split, r"(?U)\W+", "_"), F.lit("_")))
    return F.when(words == "", "unnamed").otherwise(words)


def split_column_names(values: Sequence[str | None]) -> list[tuple[str, str, str]]:
    """(split, event column, subject column) for wide mode.

    A suffix is the split's word characters in lower case, joined by ``_``; ``unnamed`` if
    none are left. Two splits with one suffix, and a null split, are errors.
    """
    made: dict[str, tuple[str, str, str]] = {}
    for value in values:
        if value is None:
            raise ValueError("subject_splits does not cover every event subject")
        suffix = "_".join(re.findall(r"\w+", value)).strip("_").lower() or "unnamed"
        if suffix in made:
            raise ValueError("split names produce duplicate output columns")
        made[suffix] = (value, f"event_count_{suffix}", f"subject_count_{suffix}")
    return list(made.values())
