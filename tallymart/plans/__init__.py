"""The operators put together: the full analysis of a raw file, and the registered queries."""
