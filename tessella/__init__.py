"""Entity x period panel analytics expressed as PySpark DataFrame operators."""
