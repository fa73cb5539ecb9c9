"""Operators on tables: function extraction and the report."""
