"""Plugins: hooks before and after every mutation, run on the driver."""

from __future__ import annotations

#: The mutations, each with ``pre_<name>(graph, context)`` and ``post_<name>(graph, context)``.
HOOKS = (
    "set_schema", "freeze_schema", "unfreeze_schema",
    "add_node", "add_node_with_group", "add_node_with_groups", "remove_node",
    "add_nodes", "add_nodes_with_group", "add_nodes_with_groups",
    "add_nodes_dataframes", "add_nodes_dataframes_with_group", "add_nodes_dataframes_with_groups",
    "add_edge", "add_edge_with_group", "add_edge_with_groups", "remove_edge",
    "add_edges", "add_edges_with_group", "add_edges_with_groups",
    "add_edges_dataframes", "add_edges_dataframes_with_group", "add_edges_dataframes_with_groups",
    "add_group", "remove_group",
    "add_node_to_group", "add_node_to_groups", "add_nodes_to_groups",
    "add_edge_to_group", "add_edge_to_groups", "add_edges_to_groups",
    "remove_node_from_group", "remove_node_from_groups", "remove_nodes_from_groups",
    "remove_edge_from_group", "remove_edge_from_groups", "remove_edges_from_groups",
    "clear",
)


class Plugin:
    """Override any hook.  A pre hook returns the context, changed or not;
    contexts are dictionaries of the call's arguments."""

    def initialize(self, graph) -> None:
        """Called when the plugin is added."""

    def finalize(self, graph) -> None:
        """Called when the plugin is removed."""


def _pre(self, graph, context: dict) -> dict:
    return context


def _post(self, graph, context: dict) -> None:
    return None


for _hook in HOOKS:
    setattr(Plugin, f"pre_{_hook}", _pre)
    setattr(Plugin, f"post_{_hook}", _post)
