"""Errors of the engine."""


class StoreError(Exception):
    """Base of all."""


class NameTaken(StoreError, ValueError):
    """A structure of that name exists."""


class NotFound(StoreError, KeyError):
    """No such structure, record or member."""


class ReadOnly(StoreError):
    """The catalog was opened for reading."""


class Dropped(StoreError):
    """The handle's structure has been dropped."""


class SchemaError(StoreError, ValueError):
    """A record or a declaration doesn't fit."""


class UniqueViolation(StoreError, ValueError):
    """Two records have one value of a unique field."""


class Empty(StoreError, IndexError):
    """Nothing to take."""


class CounterOverflow(StoreError, OverflowError):
    """A counter went beyond its maximum."""


class NestingNotSupported(StoreError, TypeError):
    """That structure can't be nested in this one."""


class WrongOwner(StoreError, ValueError):
    """A handle or an address of another structure."""


class Deleted(NotFound):
    """The record has been deleted."""


class HasHoles(StoreError, ValueError):
    """Deleted rows lie between."""
