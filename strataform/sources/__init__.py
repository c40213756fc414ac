"""Readers of delivered files and writers of versioned tables."""
