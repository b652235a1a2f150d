"""Readers of files, diffs and documents, and relations made from tables."""
