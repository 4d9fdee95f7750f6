"""Operators for training-data pipelines: de-duplication, scans, language, packing, token files."""
