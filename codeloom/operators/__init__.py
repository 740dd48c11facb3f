"""DataFrame -> DataFrame operators over the nodes and edges tables."""
