"""Stateless operators on Structured Streaming input."""
