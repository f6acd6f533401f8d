"""Readers and writers of records, configurations and texts."""
