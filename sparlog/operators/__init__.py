"""The catalogue of analytics, one module for each family."""
