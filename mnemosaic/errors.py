"""Errors, raised on the driver before any job where possible."""


class MemoryStoreError(Exception):
    """Base of all errors of the library."""


class NotFoundError(MemoryStoreError):
    """No record has this id."""


class ConfigError(MemoryStoreError, ValueError):
    """An option or argument cannot be used."""


class QueryError(MemoryStoreError, ValueError):
    """A query cannot be answered as asked."""


class EmptyQueryError(QueryError):
    pass


class ZeroVectorError(QueryError):
    pass


class DimensionMismatchError(QueryError, ConfigError):
    pass


class NoEmbeddingsError(QueryError):
    pass


class InvalidTopKError(QueryError):
    pass


class InvalidTimeRangeError(QueryError):
    pass


class NoMemoriesInRangeError(QueryError):
    pass


class InvalidMaxHopsError(QueryError):
    pass


class InvalidWeightsError(QueryError, ConfigError):
    pass


class CrossCollectionError(MemoryStoreError):
    """An edge would join two collections."""


class StorageError(MemoryStoreError, OSError):
    """The table on disk cannot be read or written."""
