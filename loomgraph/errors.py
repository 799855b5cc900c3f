"""Errors of the engine."""


class QueryError(RuntimeError):
    """A query that its data cannot answer, such as a sum over texts and numbers."""


class ConversionError(RuntimeError):
    """A value outside the value model."""


class SchemaError(ValueError):
    """Data that a schema does not allow."""
