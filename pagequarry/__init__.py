"""Page-aware document retrieval on Spark DataFrames."""

from pagequarry.config import Settings

__all__ = ["Settings"]
