"""Registered queries of the core, by module."""
