"""Operators for preparing training text: decontamination, mixing, token
counts, near-duplicates, language, personal data, quality, page extraction.

Nothing else in ``gridcube`` imports this subpackage.
"""
