"""Readers, writers and adapters of trajectory tables."""
