"""Plans of the panel analytics package."""
