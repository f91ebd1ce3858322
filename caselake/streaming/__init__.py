"""Recorded sessions as they grow."""
