"""Logical row streams that operands compile to."""
