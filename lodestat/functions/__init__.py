"""Column functions and reference distributions."""
