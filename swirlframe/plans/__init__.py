"""Whole analyses as lazy DataFrames: a pair's pixels go in as a row, its vectors come out as rows."""
