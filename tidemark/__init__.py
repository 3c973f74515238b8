"""tidemark: rarity analytics over stacks of dated raster observations, on Spark DataFrames."""

__version__ = "0.1.0"
