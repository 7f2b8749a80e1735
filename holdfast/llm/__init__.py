"""Operators for training-data pipelines.

Nothing else in the library imports this subpackage.  Each module holds one
operator; ``queries`` registers them and ``common`` has what they share.
"""
