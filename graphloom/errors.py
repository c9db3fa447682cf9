"""What can go wrong, by stage."""


class GraphError(Exception):
    """Base of all errors of this package."""


class ParseError(GraphError):
    def __init__(self, message: str, line: int = 0, column: int = 0):
        super().__init__(f"{message} at line {line}, column {column}" if line else message)
        self.line, self.column = line, column


class CatalogError(GraphError):
    """A schema that doesn't hold together."""


class TypeCheckError(GraphError):
    """A query that doesn't fit the schema; ``rule`` is T1 to T22."""

    def __init__(self, rule: str, message: str):
        super().__init__(f"{rule}: {message}")
        self.rule = rule


class PlanError(GraphError):
    """A query that can't be planned."""


class ParamError(GraphError):
    """A parameter value that doesn't fit its type."""


class LoadError(GraphError):
    """Input records that don't fit the schema."""


class ConstraintError(GraphError):
    """A key, unique, enum, null or endpoint rule that data would break."""


class StorageError(GraphError):
    """The state of a store isn't what an operation needs."""


class ConflictError(StorageError):
    """Another writer has committed first."""
