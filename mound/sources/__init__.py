"""Schemas, CSV readers and writers."""
