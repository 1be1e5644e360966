"""Prediction-market analytics on Spark DataFrames."""
