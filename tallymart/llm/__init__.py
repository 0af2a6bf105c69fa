"""Operators on text corpora: dedup, quality, personal data, secrets, language, tokens.

Nothing else in the library imports this subpackage.
"""
