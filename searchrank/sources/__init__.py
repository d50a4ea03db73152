"""Readers and writers of the search log and its derived tables."""
