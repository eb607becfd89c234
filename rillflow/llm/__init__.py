"""Training-data operators: scoring, dedup, search, packing and archive reading.

Nothing outside this folder imports it; ``queries`` holds the registered queries and their SQL.
"""
