"""Sources, sinks and encodings."""
