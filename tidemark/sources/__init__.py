"""Readers and writers of an archive's physical forms."""
