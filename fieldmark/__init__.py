"""Spark-native capture-recapture analytics: histories, likelihoods, fits and comparisons as DataFrames."""
