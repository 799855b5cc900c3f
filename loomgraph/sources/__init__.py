"""Ways into and out of a graph: frames, tuples, snapshots, connectors."""
