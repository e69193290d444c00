"""Rules over the graph, and the registered queries."""
