"""Operators that prepare training text: filtering, de-duplication, scoring, counting and packing.

Nothing else in the library imports this subpackage.
"""
