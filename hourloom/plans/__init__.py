"""hourloom plans."""
