"""Time-span analytics over media as PySpark DataFrame operators."""
