"""Operators for preparing training data: search, rules, tokens, near copies, packing, scoring, personal data."""
