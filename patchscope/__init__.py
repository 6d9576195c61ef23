"""Gridded storm analytics and forecast verification as PySpark DataFrame operators."""
