"""Scans: files, worksheet cell tables, row numbers."""
