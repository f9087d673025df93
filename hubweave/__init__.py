"""Consensus network analytics as Spark DataFrame transformations."""
