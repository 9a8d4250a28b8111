"""Outcome comparison across groups and time in clustered cohort data, on Spark."""
