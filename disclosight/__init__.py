"""Disclosure analytics expressed as Spark DataFrame transformations."""
