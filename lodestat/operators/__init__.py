"""Operators over observations and over what is derived from them."""
