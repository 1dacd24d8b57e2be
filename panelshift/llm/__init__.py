"""Operators on training texts: canonical form, evaluation leaks, source mixing, top items per group."""
