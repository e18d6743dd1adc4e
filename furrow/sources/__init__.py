"""Readers and writers of the field data files."""
