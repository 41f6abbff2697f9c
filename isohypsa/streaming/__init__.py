"""Structured Streaming forms of the message handling."""
