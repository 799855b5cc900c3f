"""The query operands: what a query function receives and returns."""
