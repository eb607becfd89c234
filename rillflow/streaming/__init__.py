"""Pipelines on Structured Streaming."""
