"""Readers and writers: landed files in, tables and documents out."""
