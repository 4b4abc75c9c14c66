"""Operators over DataFrames: text preparation, retrieval, graphs, question answering, as-of and range joins."""
