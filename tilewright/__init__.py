"""Tile analytics on Spark: tile grids, archives, vector tiles and the upkeep of large tile stores as DataFrames."""
