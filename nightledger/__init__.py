"""Lodging and booking analytics as Spark jobs."""
