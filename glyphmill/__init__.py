"""Spark-first corpus analytics and next-token modelling."""
