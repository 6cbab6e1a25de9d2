"""corpusmill: a PySpark-native engine for evidence corpora (documents, facts, graphs, retrieval)."""

__version__ = "0.1.0"
