"""Column expressions: hash draws, patch arrays, time index, units and scores."""
