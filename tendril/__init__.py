"""Analytics for time-resolved spatial graphs and voxel fields on Spark DataFrames."""
