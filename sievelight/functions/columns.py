"""Helpers for building column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used, also inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strings() -> Column:
    """An empty array of strings."""
    return F.array().cast("array<string>")


def place_of(flags: Column, wanted: bool) -> Column:
    """The place (from 1) of the first flag that is ``wanted``, or one past the end."""
    at = F.array_position(flags, F.lit(wanted))
    return F.when(at == 0, F.size(flags) + 1).otherwise(at).cast("int")


def from_place(items: Column, place: Column) -> Column:
    """The items from ``place`` (from 1) on."""
    return F.slice(items, place, F.greatest(F.lit(0), F.size(items) - place + 1))


def merged_terms(*lists: Column) -> Column:
    """Trimmed non-empty terms of all lists, each once, in order."""
    return F.array_distinct(F.filter(F.transform(F.concat(*lists), lambda t: F.trim(t)), lambda t: t != ""))
