"""Operators of the panel analytics package."""
