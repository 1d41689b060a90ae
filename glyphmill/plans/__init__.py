"""Ways to run a compiled specification over a table: Arrow batches, window functions, one regular expression."""
