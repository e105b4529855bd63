"""Column-level functions and factor families."""
