"""quillon.functions."""
