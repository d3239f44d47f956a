"""Inputs: conversation logs and the canonical tables."""
