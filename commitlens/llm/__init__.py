"""Operators for preparing training text at scale, on the table ``documents``.

Nothing else in the package imports this subpackage.
"""
