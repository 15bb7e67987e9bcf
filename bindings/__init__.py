"""Wiring of the given tables to the operators, and the comparison SQL."""
