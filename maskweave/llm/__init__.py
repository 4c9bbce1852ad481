"""Operators for preparing language-model training data.

Every module has one operator with its own general interface; ``queries`` holds
the thin registered queries.  Nothing outside this subpackage imports it.
"""
