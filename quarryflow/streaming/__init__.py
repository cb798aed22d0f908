"""Extras of this engine: incremental forms of batch operators."""
