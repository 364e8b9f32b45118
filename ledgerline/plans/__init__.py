"""Model graph, marts, the daily run and the query registry."""
