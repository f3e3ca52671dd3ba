"""Sources of the panel analytics package."""
