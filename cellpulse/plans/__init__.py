"""Plan helpers: checked broadcasts, blocked windows, dense grids and activity masks."""
