"""Scalar functions as Columns: exact arithmetic that refuses instead of rounding, and text functions."""

from . import arith, components, grammar, output, text

__all__ = ["arith", "components", "grammar", "output", "text"]
