"""Readers and writers with the library's own inference of types."""

from .csv import read_csv, read_csv_mem
from .json import read_json, read_json_mem

__all__ = ["read_csv", "read_csv_mem", "read_json", "read_json_mem"]
