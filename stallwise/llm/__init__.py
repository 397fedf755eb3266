"""Operators for preparing training corpora, with their queries."""
