"""Sinks: result tables, payload files and stored stages."""
