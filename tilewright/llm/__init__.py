"""Operators for language-model data. Nothing outside this folder imports it."""
