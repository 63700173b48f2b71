"""Windowed partial sums over streams."""
