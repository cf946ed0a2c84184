"""Registered queries of the library's own operators."""
