"""Readers, writers, profiles and file checks."""
