"""Incremental encodings of streams."""
