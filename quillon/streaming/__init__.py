"""quillon.streaming."""
