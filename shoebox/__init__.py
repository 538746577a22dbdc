"""Shoebox: media-curation analytics as PySpark DataFrame operators."""
