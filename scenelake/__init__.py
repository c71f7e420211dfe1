"""Scenario analytics on Spark: trajectories, maps, interactions, scores, predictions."""
