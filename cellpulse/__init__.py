"""Mobile-network record analytics on Spark DataFrames."""

from cellpulse.functions.timegrid import Grid

__all__ = ["Grid"]
