"""Readers: receipt trees, line-numbered logs, run dumps, task registries, driver config."""
