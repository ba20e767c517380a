"""The analyses: every operator takes DataFrames and returns one."""
