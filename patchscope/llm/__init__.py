"""Operators for training-data pipelines; nothing else in the library imports this subpackage.

Each module holds one operator with its own general interface. ``entries`` has the thin
queries over the given tables, and their SQL where SQL can state them.
"""
