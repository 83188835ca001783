"""Operators for large training-text pipelines.

Nothing outside this subpackage imports it; it can be removed as a whole.
"""
