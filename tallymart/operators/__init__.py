"""DataFrame-to-DataFrame transformations. Column names are parameters with the cleaned names as defaults."""
