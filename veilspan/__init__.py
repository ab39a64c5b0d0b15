"""Sensitive-data scanning and redaction as Spark DataFrame operations."""

from veilspan.config import ScanConfig

__all__ = ["ScanConfig"]
