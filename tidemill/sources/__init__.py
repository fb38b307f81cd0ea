"""Readers, writers and the table registry."""

from tidemill.sources.readers import DatasetRef, load, load_split
from tidemill.sources.registry import TableRegistry
from tidemill.sources.writers import json_records, write_table

__all__ = ["DatasetRef", "TableRegistry", "json_records", "load", "load_split", "write_table"]
