"""Operators for preparing language-model training data.

Each module holds one operator; ``queries`` registers one query per operator
over the driver tables.  Nothing else in the library imports this subpackage.
"""
