"""Operators for preparing training corpora: deduplication, scoring, filtering, packing.

Nothing else in the library imports this subpackage.
"""
