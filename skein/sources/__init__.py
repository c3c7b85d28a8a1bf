"""Readers of the tables and of raw landed files."""

from skein.sources.tables import spread, table

__all__ = ["spread", "table"]
