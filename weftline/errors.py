"""Errors that callers may catch."""


class InvalidOperationError(Exception):
    """The object does not allow this operation now."""


class NoneArgumentError(Exception):
    """An argument that must be given is None."""


class SchemaError(Exception):
    """A schema operation can't be done."""
