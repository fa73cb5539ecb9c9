"""Whole queries: the report over a source tree, and the operators over the test tables."""
