"""Structured Streaming forms of the operators that are naturally incremental."""
