"""arborel: point-cloud, skeleton-graph and quality-metric analytics on Spark DataFrames."""
