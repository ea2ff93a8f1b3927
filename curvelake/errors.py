"""Errors that say what a user did wrong."""


class FieldError(Exception):
    """A request that the data or the declared types do not allow."""
