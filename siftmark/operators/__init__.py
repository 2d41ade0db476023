"""Operators on files, lines, packages and findings."""
