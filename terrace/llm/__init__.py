"""Operators for building language-model training data from web documents.

Nothing outside this subpackage imports it; the registry module lists its queries.
"""
