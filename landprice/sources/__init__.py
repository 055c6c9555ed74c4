"""Readers, the register table and the view over the star-schema tables."""
