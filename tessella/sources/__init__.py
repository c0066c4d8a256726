"""Roles of columns, readers and writers."""
