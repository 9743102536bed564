"""Errors of the engine, by kind."""


class EngineError(Exception):
    """Base of all errors raised here."""


class ParseError(EngineError):
    pass


class CollectionNotFound(EngineError):
    pass


class CollectionExists(EngineError):
    pass


class EntityNotFound(EngineError):
    pass


class DimensionMismatch(EngineError):
    pass


class InvalidQuery(EngineError):
    pass


class EdgeTypeNotFound(EngineError):
    pass


class EdgeTypeExists(EngineError):
    pass


class DuplicateName(EngineError):
    """A representation, field or index name that is there already."""


class InvalidStateTransition(EngineError):
    pass


class BudgetExceeded(EngineError):
    def __init__(self, estimated: float, budget: float):
        super().__init__(f"estimated {estimated:.1f} cost units, budget {budget:.1f}")
        self.estimated, self.budget = estimated, budget


class NoCandidates(EngineError):
    """No node is alive."""


class ClusterOverloaded(EngineError):
    """Every node that is alive sheds load."""
