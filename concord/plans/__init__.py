"""Schemas: constraints as values, normalised on the driver and compiled to Columns."""

from .constraint import (
    ANY, Constraint, above, below, const, contains, empty, enum, fmt, kind, len_, max_, min_, mulof, must, neq, nof, nothing, pattern, rest, unique, when,
)
from .schema import Field, Schema

__all__ = [
    "ANY", "Constraint", "Field", "Schema", "above", "below", "const", "contains", "empty", "enum", "fmt", "kind", "len_", "max_", "min_", "mulof", "must",
    "neq", "nof", "nothing", "pattern", "rest", "unique", "when",
]
