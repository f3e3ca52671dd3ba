"""Functions of the panel analytics package."""
