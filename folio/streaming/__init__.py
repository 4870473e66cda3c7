"""Structured Streaming over stage events."""
