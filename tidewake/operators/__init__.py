"""DataFrame operators: each takes DataFrames and returns a new lazy DataFrame."""
