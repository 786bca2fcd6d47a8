"""Errors of the document engine."""

from __future__ import annotations


class TreeError(Exception):
    """Base of all errors that the engine raises itself."""


class EngineError(TreeError):
    """The storage under a table failed."""


class InvalidPath(TreeError):
    """A path does not follow the grammar."""


class InvalidTableName(TreeError):
    """A table name is empty or reserved."""


class PathNotFound(TreeError):
    """A typed load found nothing at the path."""


class UnexpectedNode(TreeError):
    """A node is not of the kind that the operation needs."""

    def __init__(self, path: str, expected: str, found: str):
        super().__init__(f"{path!r}: expected {expected}, found {found}")
        self.path, self.expected, self.found = path, expected, found


class BadKey(TreeError):
    """A key can't be read."""


class TypeMismatch(TreeError):
    """A leaf has another scalar type than was asked for."""

    def __init__(self, expected: str, found: str):
        super().__init__(f"expected {expected}, found {found}")
        self.expected, self.found = expected, found


class IndexOutOfRange(TreeError):
    """A list position lies beyond the list."""

    def __init__(self, index: int, length: int):
        super().__init__(f"index {index} out of range for length {length}")
        self.index, self.length = index, length


class Corrupt(TreeError):
    """Stored data can't be what it should be."""


class UniqueViolation(TreeError):
    """Two entities share the columns of a unique index."""


class IndexNotFound(TreeError):
    """No index has that name."""


class IndexArity(TreeError):
    """More values than the index has columns."""


class SchemaMismatch(TreeError):
    """A definition differs from the one that is registered."""


class CannotAccess(TreeError):
    """An accessor can't be made for this shape."""


class Conversion(TreeError):
    """A value could not be converted."""


class CommitConflict(EngineError):
    """Another handle or process has committed to the table since the transaction began."""
