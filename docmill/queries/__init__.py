"""Checked queries over the given tables, each next to the SQL that states its expected result."""
