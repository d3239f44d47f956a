"""Composition of operators into one logical plan."""
