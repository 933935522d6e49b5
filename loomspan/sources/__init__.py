"""Readers and writers of measurement tables, the star schema and metadata."""
