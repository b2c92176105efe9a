"""Foliant: document-structure, usage and training-data analytics as Spark jobs."""
