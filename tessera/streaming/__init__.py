"""Structured Streaming operators and a way to run them to the end of what there is."""
