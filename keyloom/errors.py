"""What the engine raises."""


class KeyloomError(Exception):
    pass


class UnknownTable(KeyloomError):
    pass


class WrongType(KeyloomError):
    """A response of another table or verb was asked for."""


class SchemaMismatch(KeyloomError):
    pass


class NullKey(KeyloomError):
    pass


class ImmutableColumn(KeyloomError):
    """An update would change a key or sort column."""


class TableLocked(KeyloomError):
    """Another writer holds the table."""


class CorruptManifest(KeyloomError):
    pass
