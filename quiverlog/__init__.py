"""Graph Datalog on Spark: triples in DataFrames, programs compiled to DataFrame plans."""

from quiverlog.engine import Engine
from quiverlog.sources.store import GraphStore

__all__ = ["Engine", "GraphStore"]
