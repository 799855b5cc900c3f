"""Typed value expressions."""
