"""Structured Streaming over zone changes."""
