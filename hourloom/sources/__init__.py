"""hourloom sources."""
