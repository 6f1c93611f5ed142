"""Annalist: evidence-backed event data on Spark."""
