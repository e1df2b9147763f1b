"""Readers of landed files and the writers of the stored tables."""
