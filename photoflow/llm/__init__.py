"""Operators for cleaning and packing language-model training text."""
