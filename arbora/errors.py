"""Errors of the graph engine."""


class GraphError(Exception):
    """Base of all errors here."""


class CycleError(GraphError):
    def __init__(self, path: list[str]):
        super().__init__("cycle: " + " -> ".join(path))
        self.path = path


class DuplicateNodeError(GraphError):
    pass


class NodeNotFoundError(GraphError):
    pass


class EdgeNotFoundError(GraphError):
    pass


class StaleNodeRefError(GraphError):
    pass


class TooLargeError(GraphError):
    """A sequential operator was asked for on a graph that doesn't fit one task."""


class TemplateError(GraphError):
    pass


class GateRejectedError(GraphError):
    pass


class GateTimeoutError(GraphError):
    pass
