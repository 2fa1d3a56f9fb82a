"""Readers and writers, and the derived detection tables."""
