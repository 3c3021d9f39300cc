"""Attributed-network panel analytics on Spark."""
