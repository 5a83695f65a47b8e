"""Wildfire detection, event and forecast-evaluation analytics on Spark DataFrames."""
