"""Spatio-temporal crowd analytics and corpus preparation on Spark DataFrames."""
