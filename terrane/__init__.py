"""Spatial-graph analytics on Spark: plane geometry, spatial joins, region graphs, sampling and run analytics."""
