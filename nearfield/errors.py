"""Exceptions raised while a plan is built (runtime errors come from ``raise_error`` in the plan)."""


class VectorError(ValueError):
    """A vector value, specification or query that the engine rejects."""
