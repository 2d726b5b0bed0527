"""Structured Streaming forms of the request checks, scoring and monitoring."""
