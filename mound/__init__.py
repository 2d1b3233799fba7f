"""Pitch-by-pitch features, checks and probabilities as Spark jobs."""
