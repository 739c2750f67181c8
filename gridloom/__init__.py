"""Gridloom: retrieval analytics over gridded inspection data, as Spark plans."""
