"""Structured Streaming forms of the batch operators: windows, sessions, de-duplication, absence."""
