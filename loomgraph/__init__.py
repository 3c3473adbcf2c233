"""loomgraph: a Spark-native document graph and retrieval engine."""

__version__ = "0.1.0"
