"""Column functions: each takes Columns and returns a Column."""
