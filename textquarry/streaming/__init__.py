"""Keeping derived tables fresh."""
