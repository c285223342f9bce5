"""Readers of documents in nine formats, and writers."""

from .readers import EXTENSIONS, read
from .writers import write_json, write_text

__all__ = ["EXTENSIONS", "read", "write_json", "write_text"]
