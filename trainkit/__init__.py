"""Spark jobs for the data work around training and evaluating vision and representation models."""
