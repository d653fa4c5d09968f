"""Operators on trajectory tables."""
