"""hourloom operators."""
