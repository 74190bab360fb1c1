"""Small helpers to write long rule chains as Spark SQL text.

A chain of a hundred replacements built call by call costs a JVM round trip per step; as one SQL expression it
is handed over once. The text is parsed into the same built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def raw(text: str) -> str:
    """A raw SQL string literal."""
    if "'" in text:
        raise ValueError(f"no single quotes in raw literals: {text!r}")
    return f"R'{text}'"


def swap(value: str, pairs) -> str:
    """Plain replacements, in order."""
    for before, after in pairs:
        value = f"replace({value}, {raw(before)}, {raw(after)})"
    return value


def regex(value: str, *rules: tuple[str, str]) -> str:
    """Regular-expression replacements, in order."""
    for pattern, replacement in rules:
        value = f"regexp_replace({value}, {raw(pattern)}, {raw(replacement)})"
    return value


def bind(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is evaluated once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def trim(value: str) -> str:
    return regex(value, (r"^\s+|\s+$", ""))


def apply(body: str, **columns: Column) -> Column:
    """Evaluate SQL text over columns; the text refers to them as ``arg.<name>``."""
    packed = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return F.get(F.call_function("transform", packed, F.expr(f"arg -> {body}")), F.lit(0))
