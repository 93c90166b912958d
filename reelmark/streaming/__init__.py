"""Streaming forms of the audit."""
