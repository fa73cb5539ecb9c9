"""Schemas of the tables between operators."""

FILES = "path string, lang string"
#: One row a function; files that could not be read have one row with null line and name.
ELEMENTS = "file string, lang string, line long, name string, receiver string, capture_index int, match_ord int, status string"
GIT_LOG = "file string, name string, log string, status string"
REPORT = "file string, line long, name string, frequency long"
