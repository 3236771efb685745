"""Column helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What lies between words: blanks, tabs, line feeds, vertical tabs, form feeds, carriage returns.
BLANK_RUN = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is evaluated once per row, also where the body is a higher-order function."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text: runs of characters other than these; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK_RUN), lambda w: w != "")


def plus_columns(columns: list[str], added: list[str]) -> list[str]:
    """The columns of an input that stay beside added ones; an added column replaces one of its name (case aside)."""
    taken = {x.lower() for x in added}
    return [x for x in columns if x.lower() not in taken]


def unused(columns: list[str], *names: str) -> list[str]:
    """Working names that no column has, case aside."""
    taken = {x.lower() for x in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
