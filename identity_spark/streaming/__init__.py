"""Structured Streaming forms of the operators with state."""
