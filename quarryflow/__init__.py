"""A PySpark-native analytics engine: relational lists, graph reachability, vector search, extraction and SQL guarding."""
