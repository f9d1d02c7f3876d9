"""Queries composed of operators, with their oracles."""
