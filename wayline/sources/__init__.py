"""Readers and writers of trajectory files."""
