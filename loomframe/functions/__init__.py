"""Functions of loomframe."""
