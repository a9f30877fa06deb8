"""Operators for preparing language-model training data; nothing else in weft imports this package."""
