"""Listing-market analytics as plain Spark DataFrame transformations."""
