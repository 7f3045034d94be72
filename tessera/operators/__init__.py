"""DataFrame transforms: each takes DataFrames and returns one."""
