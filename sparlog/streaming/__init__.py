"""Continuous ingest and live loop detection."""
