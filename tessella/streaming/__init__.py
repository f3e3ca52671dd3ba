"""Streaming of the panel analytics package."""
