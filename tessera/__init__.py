"""Tessera: retrieval, graph, question-answering and relational operators over Spark DataFrames."""
