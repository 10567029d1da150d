"""Operators of loomframe."""
