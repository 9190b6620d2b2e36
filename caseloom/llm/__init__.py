"""Operators for large-scale training-data preparation.

Nothing else in the library imports this subpackage. ``queries`` holds the thin,
contract-bound queries; every operator module keeps its own general interface.
"""
