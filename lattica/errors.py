"""What graph operators raise."""


class GraphError(ValueError):
    pass


class NodeNotFound(GraphError):
    pass


class NodeDeleted(GraphError):
    pass


class EdgeNotFound(GraphError):
    pass


class NegativeWeight(GraphError):
    pass


class NegativeCycle(GraphError):
    pass


class GraphHasCycle(GraphError):
    pass


class TooLarge(GraphError):
    """A graph is beyond the documented bound of a driver-side algorithm."""
