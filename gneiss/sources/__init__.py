"""Readers and writers of table data."""
