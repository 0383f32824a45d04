"""weftmill: knowledge-base, retrieval, board and stream analytics expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
