"""Operators for preparing training text at scale: deduplication, decontamination, filtering and mixing.

Nothing else in the library imports this subpackage.
"""
