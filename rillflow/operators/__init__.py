"""Nodes of a pipeline."""
