"""Fixed tables as constant expressions.

A table of a few dozen fixed values becomes one map or array literal in the plan: it
needs no join, no broadcast and no size check, and Catalyst folds it to a constant.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def sql_literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return f"double('{value!r}')"
    if isinstance(value, int):
        return f"bigint({value})"
    if isinstance(value, (list, tuple)):
        inner = ", ".join(sql_literal(v) for v in value)
        return f"array({inner})" if value else "cast(array() AS array<string>)"
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


def map_of(pairs: Mapping | Iterable[tuple]) -> Column:
    items = pairs.items() if isinstance(pairs, Mapping) else pairs
    return F.expr("map(" + ", ".join(f"{sql_literal(k)}, {sql_literal(v)}" for k, v in items) + ")")


def structs_of(fields: Mapping[str, str], rows: Iterable[tuple]) -> Column:
    """Array of structs; ``fields`` maps each field name to its SQL type."""
    body = ", ".join(
        "named_struct("
        + ", ".join(f"'{n}', cast({sql_literal(v)} AS {t})" for (n, t), v in zip(fields.items(), row))
        + ")"
        for row in rows
    )
    return F.expr(f"array({body})")
