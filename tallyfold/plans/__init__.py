"""Queries over the given tables, each beside SQL that says the same."""
