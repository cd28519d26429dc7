"""Incremental forms of the stateless operators."""
