"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it, and it imports nothing from the
rest of the library, so it can be removed as a whole.
"""
