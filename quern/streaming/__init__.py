"""Streaming twins of the state operators, on Structured Streaming."""
