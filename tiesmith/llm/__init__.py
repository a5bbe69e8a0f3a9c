"""Operators for large-scale training data, one module each.

Nothing outside this package imports it; delete it (and tests/llm) and the rest still works.
"""
