"""Operators for text corpora and sketches; nothing else in the library imports this subpackage."""
