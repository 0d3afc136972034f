"""Operators on catalogues, recordings and self-report tables."""
