"""Columns of the caller whose names an operator needs for itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def set_aside(docs: DataFrame, clashes: Callable[[str], bool]) -> tuple[DataFrame, dict[str, Column]]:
    """docs with the clashing columns under free names, and for each old name the column to select it back.

    `clashes` gets names in lower case, as Spark doesn't tell cases apart; it must not hold for every
    name with `own_` in front of a clashing one.
    """
    taken, held = {c.lower() for c in docs.columns}, {}
    for name in docs.columns:
        free = name
        while clashes(free.lower()) or (free != name and free.lower() in taken):
            free = f"own_{free}"
        taken.add(free.lower())
        held[name] = free
    back = {name: _quoted(free).alias(name) for name, free in held.items()}
    if all(name == free for name, free in held.items()):
        return docs, back
    return docs.select(*[_quoted(name).alias(free) for name, free in held.items()]), back
