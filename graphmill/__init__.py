"""Property-graph, symbol-search and training-data operators on PySpark."""
