"""Loomgraph: attributed property graphs and their query algebra on PySpark."""

from .errors import ConversionError, QueryError, SchemaError
from .graph import GraphBuilder, PropertyGraph
from .operators.operands import Discriminator, EdgeDirection, EdgeGroupBy, EdgeOperand, MatchMode, NodeGroupBy, NodeOperand
from .plugins import Plugin
from .sources.connectors import ConnectedGraph, Connector, ExportConnector, IngestConnector

__all__ = [
    "ConnectedGraph", "Connector", "ConversionError", "Discriminator", "EdgeDirection", "EdgeGroupBy", "EdgeOperand", "ExportConnector", "GraphBuilder",
    "IngestConnector", "MatchMode", "NodeGroupBy", "NodeOperand", "Plugin", "PropertyGraph", "QueryError", "SchemaError",
]
