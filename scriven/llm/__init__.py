"""Operators for preparing language-model training corpora; nothing outside this package imports it."""
