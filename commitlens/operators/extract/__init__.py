"""Function extraction: a module for each language, on the tokens of ``lexer``."""
