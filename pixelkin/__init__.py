"""Media catalog, organizing and near-duplicate engine on Spark DataFrames."""

from pixelkin.config import DedupConfig

__all__ = ["DedupConfig"]
