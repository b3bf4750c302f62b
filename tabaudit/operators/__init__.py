"""DataFrame in, DataFrame out. Nothing here runs a job; Catalyst sees the whole plan."""
