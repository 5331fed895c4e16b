"""kinshelf: organise document collections by content with Spark DataFrames."""

from kinshelf.config import Settings

__all__ = ["Settings"]
