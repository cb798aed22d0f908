"""Relational lists, state transitions, extraction, graph, vector, context and SQL guard operators."""
