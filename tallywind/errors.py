"""Errors the library raises before a query runs."""

from __future__ import annotations

import difflib
from collections.abc import Iterable


class TypeMismatch(TypeError):
    """An operation does not exist for a column's type."""


class UnknownName(KeyError):
    """No column of that name; the message suggests the nearest."""

    def __init__(self, name: str, known: Iterable[str]) -> None:
        near = difflib.get_close_matches(name, list(known), 1)
        super().__init__(f"no column {name!r}" + (f"; did you mean {near[0]!r}?" if near else ""))


class MissingKey(ValueError):
    """A key of a join, grouping or pivot is absent."""
