"""Operators for preparing training text: ten batch operators on DataFrames.

Nothing else in the library imports this subpackage.
"""
