"""Analytics over voxel, series, edge and feature tables as plain Spark DataFrame functions."""
