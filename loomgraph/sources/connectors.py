"""Connectors: user code that fills a graph from a system or exports to one."""

from __future__ import annotations

from ..graph import PropertyGraph


class Connector:
    """Lifecycle of a connection."""

    def initialize(self, graph: PropertyGraph) -> None:
        """Called once the graph exists."""

    def disconnect(self, graph: PropertyGraph) -> None:
        """Called when the graph lets go of the connector."""


class IngestConnector(Connector):
    def ingest(self, graph: PropertyGraph, data) -> None:
        """Add ``data`` to the graph."""
        raise NotImplementedError


class ExportConnector(Connector):
    def export(self, graph: PropertyGraph):
        """What the other system gets."""
        raise NotImplementedError


class ConnectedGraph:
    """A graph with a connector; every attribute of the graph is at hand."""

    def __init__(self, spark, connector: Connector, data=None, graph: PropertyGraph | None = None):
        self.graph = graph or PropertyGraph(spark)
        self.connector = connector
        connector.initialize(self.graph)
        if data is not None:
            self.ingest(data)

    def __getattr__(self, name):
        return getattr(self.graph, name)

    def ingest(self, data) -> None:
        if not isinstance(self.connector, IngestConnector):
            raise TypeError("the connector does not ingest")
        self.connector.ingest(self.graph, data)

    def export(self):
        if not isinstance(self.connector, ExportConnector):
            raise TypeError("the connector does not export")
        return self.connector.export(self.graph)

    def disconnect(self) -> PropertyGraph:
        """The plain graph."""
        self.connector.disconnect(self.graph)
        return self.graph
