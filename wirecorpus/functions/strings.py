"""Text expressions: template filling, literal lookups, ordered replacements."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F


def fill(template: str, **values: Column) -> Column:
    """Fill ``{name}`` slots of a constant template with columns."""
    parts = re.split(r"\{(\w+)\}", template)
    pieces = [values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p]
    return F.concat(*pieces)


def lookup(table: Mapping[str, str], key: Column) -> Column:
    """Value of a small constant table; null where the key is absent."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), key)


def replace_all(text: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """Literal replacements in the given order."""
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def last_word(text: Column) -> Column:
    return F.element_at(F.split(text, " "), -1)


def drop_last_char(text: Column) -> Column:
    return F.substring(text, F.lit(1), F.greatest(F.length(text) - 1, F.lit(0)))


def present(text: Column) -> Column:
    return F.length(F.coalesce(text, F.lit(""))) > 0


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")
