"""Writers for tables, adjacency text, distributions and per-station records."""
