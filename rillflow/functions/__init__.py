"""The expression language and the SQL functions."""
