"""Column and aggregate builders: curves, vector and matrix norms, regression errors, and their registry."""
