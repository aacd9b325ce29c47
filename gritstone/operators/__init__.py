"""Operators on queries: rewriting, validation, measurement, decision, analysis."""
