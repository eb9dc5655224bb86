"""Files read and written, and the input tables."""
