"""twinsieve: exact and near-duplicate document analytics on Spark DataFrames."""

__version__ = "0.1.0"
