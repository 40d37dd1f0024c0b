"""Spark jobs that audit web-application source held in tables."""
