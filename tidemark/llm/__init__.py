"""Operators that prepare training data: language ID, deduplication, mixing, tokens, archives.

Nothing outside this subpackage imports it.  ``queries`` holds the registered
queries; every other module is one operator with its own general interface.
"""
