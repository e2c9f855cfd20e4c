"""Readers, writers and the catalog of named datasets."""
