"""fojas: document retrieval and corpus processing written with Spark DataFrames."""

__version__ = "0.1.0"
