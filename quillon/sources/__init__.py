"""quillon.sources."""
