"""loomery: a Spark-first engine for hybrid retrieval, property graphs and evaluation analytics."""
