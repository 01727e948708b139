"""Errors that this package raises."""


class TidemarkError(Exception):
    """Base of all of them."""


class DefinitionError(TidemarkError):
    """An entity's declaration contradicts itself."""


class QueryError(TidemarkError):
    """A query can't mean what was asked of it."""


class NotSupported(QueryError):
    """Spark has nothing that keeps this promise (row locks, output parameters, isolation levels)."""


class NoRows(TidemarkError):
    """A row was asked for and there is none."""


class TooManyRows(TidemarkError):
    """One row was asked for and there are more."""


class VersionConflict(TidemarkError):
    """Rows changed since they were read, or another writer committed first."""


class ConstraintError(TidemarkError):
    """Rows break a key, uniqueness or not-null rule."""


class CircuitOpen(TidemarkError):
    """Calls are refused until the breaker's pause is over."""


class SessionBusy(TidemarkError):
    """Another operation of this session is running."""
