"""Readers and writers for tables, documents, objects, points, logs and databases."""
