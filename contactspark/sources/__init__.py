"""Readers and writers of maps, call lists and stage results."""
