"""Structured Streaming: message parsing, validation, scoring, live counters, event log."""
