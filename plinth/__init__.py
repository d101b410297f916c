"""plinth: floor-plan drawings and training corpora as Spark tables."""

__version__ = "0.1.0"
