"""Named queries over the given tables, each with an independent SQL statement of the same result."""
