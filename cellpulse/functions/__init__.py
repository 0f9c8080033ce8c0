"""Column functions: cells, time buckets, distances and record measures."""
