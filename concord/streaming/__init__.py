"""Validation of streams."""

from .vet import vet_stream, violations_by_window, watch_unique

__all__ = ["vet_stream", "violations_by_window", "watch_unique"]
