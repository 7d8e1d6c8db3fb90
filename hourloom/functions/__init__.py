"""hourloom functions."""
