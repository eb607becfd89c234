"""Graphs, the builder, SQL plans and registered queries."""
