"""DataFrame-to-DataFrame operators. Keys are columns, never Python loops."""
