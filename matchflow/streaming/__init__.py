"""Structured Streaming jobs over traces, postings and history."""
