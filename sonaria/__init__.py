"""Sonaria: interval, frame-series and spectral analytics on Spark DataFrames."""
