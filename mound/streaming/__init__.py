"""Structured Streaming: live counters, late data, replayed rows, scores of rows as they come."""
