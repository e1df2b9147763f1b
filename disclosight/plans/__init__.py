"""Whole-table jobs composed from operators and functions."""
