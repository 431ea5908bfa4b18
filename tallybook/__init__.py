"""Tallybook: results, rankings and ratings of two-player games as Spark jobs."""
