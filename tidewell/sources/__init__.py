"""Readers and the transforms that belong to one kind of source."""
