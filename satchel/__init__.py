"""Satchel: select, protect, measure and pack large text corpora on Spark."""
