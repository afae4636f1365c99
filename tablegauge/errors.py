"""Exceptions of the file sources."""


class TableGaugeError(Exception):
    """Base of all errors this package raises itself."""


class LoadError(TableGaugeError):
    """A file cannot be read as a table."""


class EmptyTableError(LoadError):
    """A file holds no data row."""
