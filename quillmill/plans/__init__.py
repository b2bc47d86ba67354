"""Chains of operators, the algorithm registry and reports."""
